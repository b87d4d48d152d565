"""Queries of read analysis with errors (mates, strands, barcodes between constants, associates, counts by combinations), of repeats and
of made parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import alignment as A
from ..operators import fuzzy, kmers, maker, reads
from ..operators.graphs import settled
from .base import Group

group = Group()
query = group.query
DNA = "translate(md5(CAST({} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
OTHER = "translate({}, 'ACGT', 'CGTA')"


def changed(s, at, when):
    """s with another letter at a place (from 1) where a condition holds."""
    letter = F.translate(F.substring(s, at, F.lit(1)), "ACGT", "CGTA")
    return F.when(when, F.concat(F.substring(s, F.lit(1), at - 1), letter, F.substring(s, at + 1, F.length(s)))).otherwise(s)


def spread(df):
    """A table of few files over all cores, for the making of reads."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def less(s, at, when):
    """s without the letter at a place where a condition holds."""
    return F.when(when, F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, F.length(s)))).otherwise(s)


def changed_sql(s, at, when):
    return f"CASE WHEN {when} THEN substr({s}, 1, {at} - 1) || {OTHER.format(f'substr({s}, {at}, 1)')} || substr({s}, {at} + 1) ELSE {s} END"


def less_sql(s, at, when):
    return f"CASE WHEN {when} THEN substr({s}, 1, {at} - 1) || substr({s}, {at} + 1) ELSE {s} END"


# Mates of 24 and 22 letters of a fragment of 32, with changed and missing letters; two kinds of them lie the other way round or have nothing in common.


def mates(t):
    f = F.concat(F.lit("AACCGGTTAC"), F.substring(S.derived_dna(F.col("l_suppkey")), 1, 12), F.lit("TTGGCCAATG"))
    rows = spread(t.lineitem).select("l_orderkey", "l_linenumber", f.alias("f"), F.col("l_linenumber").alias("v"), (F.col("l_orderkey") % 5).cast("int").alias("e"))
    part = lambda at, n: F.substring("f", at, n)
    v, e = F.col("v"), F.col("e")
    rows = rows.withColumn("r1", F.when(v == 6, part(9, 24)).otherwise(part(1, 24))).withColumn("r2", F.when(v == 6, part(1, 22)).when(v == 7, F.reverse("f")).otherwise(part(11, 22)))
    rows = rows.withColumn("r1", changed(F.col("r1"), 12 + 2 * e, v.isin(2, 3, 5))).withColumn("r2", changed(F.col("r2"), 5 + e, v.isin(3, 4)))
    rows = rows.withColumn("r2", less(F.col("r2"), 6 + e, v == 5)).select("l_orderkey", "l_linenumber", "r1", "r2")
    # Written: a filter on reads would otherwise be pushed down to the table, with each step's expressions written out in full.
    return settled(rows).withColumn("q1", F.rpad(F.lit(""), 24, "FI")).withColumn("q2", F.rpad(F.lit(""), 40, "GH#"))


_R1 = changed_sql("CASE WHEN v = 6 THEN substr(f, 9, 24) ELSE substr(f, 1, 24) END", "(12 + 2 * e)", "v IN (2, 3, 5)")
_R2 = changed_sql("(CASE WHEN v = 6 THEN substr(f, 1, 22) WHEN v = 7 THEN reverse(f) ELSE substr(f, 11, 22) END)", "(5 + e)", "v IN (3, 4)")
_R2 = less_sql(f"({_R2})", "(6 + e)", "v = 5")
_MATES = f"""WITH f AS (SELECT l_orderkey, l_linenumber, 'AACCGGTTAC' || substr({DNA.format('l_suppkey')}, 1, 12) || 'TTGGCCAATG' AS f, l_linenumber AS v, l_orderkey % 5 AS e FROM lineitem),
m AS (SELECT l_orderkey, l_linenumber, {_R1} AS r1, {_R2} AS r2 FROM f), p AS (SELECT DISTINCT r1, r2 FROM m),
w AS (SELECT r1, r2, 'i' AS kind, r1 AS l, r2 AS r FROM p UNION ALL SELECT r1, r2, 'o', r2, r1 FROM p),
s AS (SELECT r1, r2, kind, l, r, j, min(levenshtein(right(l, 10), substr(r, j - n + 1, n))) AS d FROM w, range(1, 33) x(j), range(1, 15) y(n) WHERE j <= length(r) AND n <= j GROUP BY ALL),
b AS (SELECT r1, r2, kind, l, r, min(j) AS n FROM (SELECT *, min(d) OVER (PARTITION BY r1, r2, kind) AS least FROM s) WHERE d = least AND least <= 4 GROUP BY ALL HAVING count(*) <= 10 AND min(j) >= 10 AND min(j) <= length(l)),
h AS (SELECT *, hamming(right(l, n), left(r, n)) AS h FROM b),
g AS (SELECT r1, r2, kind, min(levenshtein(left(r, n), substr(l, i, k))) AS d FROM h, range(1, 33) x(i), range(1, 33) y(k) WHERE h > 0 AND i + k <= length(l) + 1 GROUP BY ALL),
o AS (SELECT h.* FROM h LEFT JOIN g USING (r1, r2, kind) WHERE h <= 10 AND (h = 0 OR d >= h)),
c AS (SELECT p.r1, p.r2, i.n AS ni, i.h AS hi, o.n AS no, o.h AS ho FROM p LEFT JOIN (SELECT * FROM o WHERE kind = 'i') i USING (r1, r2) LEFT JOIN (SELECT * FROM o WHERE kind = 'o') o USING (r1, r2))"""
_BETTER = "CASE WHEN substr(rpad('', 24, 'FI'), {0}, 1) < substr(rpad('', 40, 'GH#'), {1}, 1) THEN substr(r2, {1}, 1) ELSE substr(r1, {0}, 1) END"
_JOINED = f"""CASE WHEN hi = 0 OR hi < coalesce(ho, 99) THEN substr(r1, 1, length(r1) - ni) || array_to_string(list_transform(range(1, ni + 1), lambda k: {_BETTER.format('(length(r1) - ni + k)', 'k')}), '') || substr(r2, ni + 1)
WHEN ho < coalesce(hi, 99) THEN array_to_string(list_transform(range(1, no + 1), lambda k: {_BETTER.format('k', '(length(r2) - no + k)')}), '') END"""


@query("e07_merged_mates", _MATES + f", j AS (SELECT r1, r2, {_JOINED} AS merged FROM c) SELECT l_orderkey, l_linenumber, merged FROM m LEFT JOIN j USING (r1, r2)")
def e07(t):
    return A.merged(mates(t), "r1", "r2", "q1", "q2").select("l_orderkey", "l_linenumber", "merged")


# Barcodes of 8 letters between two constants of 9 with changed, missing and further letters; a quarter on the other strand.

_PRE, _SUF = "GATTACAGT", "CTTGACCAT"
_KIND = "p_partkey % 7"


def constructs(t):
    d, k, e = S.derived_dna(F.col("p_partkey")), F.col("p_partkey") % 7, (F.col("p_partkey") % 9 + 1).cast("int")
    pre, suf = less(changed(F.lit(_PRE), e, k.isin(1, 3)), F.lit(4), k.isin(2, 3)), changed(F.lit(_SUF), e, k.isin(4, 5))
    suf = F.when(k == 5, F.concat(F.lit("C"), F.substring(suf, 2, 9))).when(k == 6, F.substring(suf, 1, 4)).otherwise(suf)
    s = F.concat(F.substring(d, 20, 5), pre, F.substring(d, 1, 8), suf, F.substring(d, 26, 6))
    return t.part.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, S.reverse_complement(s)).otherwise(s).alias("s"))


ELEMENTS = {"after": A.Element(_PRE, None, 8, 1, 2), "before": A.Element(None, _SUF, 8, 1, 2), "both": A.Element(_PRE, _SUF, 8, 1, 2)}
_E = "CAST(p_partkey % 9 + 1 AS INT)"
_PRE_SQL = less_sql("(" + changed_sql(f"'{_PRE}'", _E, f"{_KIND} IN (1, 3)") + ")", "4", f"{_KIND} IN (2, 3)")
_SUF_SQL = "(" + changed_sql(f"'{_SUF}'", _E, f"{_KIND} IN (4, 5)") + ")"
_SUF_SQL = f"CASE {_KIND} WHEN 5 THEN 'C' || substr({_SUF_SQL}, 2) WHEN 6 THEN substr({_SUF_SQL}, 1, 4) ELSE {_SUF_SQL} END"
_REV = "reverse(translate({}, 'ACGT', 'TGCA'))"
_CONSTRUCTS = f"""WITH d AS (SELECT p_partkey, {DNA.format('p_partkey')} AS d FROM part), x AS (SELECT p_partkey, substr(d, 20, 5) || ({_PRE_SQL}) || substr(d, 1, 8) || ({_SUF_SQL}) || substr(d, 26, 6) AS x FROM d),
r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN {_REV.format('x')} ELSE x END AS s FROM x)"""


def places_sql(name: str, source: str, const: str, errors: int) -> str:
    """name (id, d, first, last, start) of the nearest places of a constant in source (id, s), by comparing it with every substring."""
    n = len(const)
    return f""", {name}_all AS (SELECT id, j, n, levenshtein('{const}', substr(s, j - n + 1, n)) AS d FROM {source}, range(1, 64) a(j), range({n - errors}, {n + errors + 1}) b(n) WHERE j <= length(s) AND n <= j),
{name} AS (SELECT id, least AS d, min(j) AS first, max(j) AS last, min(j - n) FILTER (WHERE j = e) AS start FROM (SELECT *, min(j) OVER (PARTITION BY id) AS e FROM (SELECT *, min(d) OVER (PARTITION BY id) AS least FROM {name}_all) WHERE d = least) WHERE d <= {errors} GROUP BY id, least)"""


def strand_sql(name: str, source: str, anchor: str, errors: int) -> str:
    back = anchor[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return places_sql(f"{name}_f", source, anchor, errors) + places_sql(f"{name}_b", source, back, errors) + f""", {name} AS (SELECT r.id, CASE WHEN length(s) < {len(anchor) - errors} THEN NULL
WHEN contains(s, '{anchor}') OR contains(s, '{back}') THEN CASE WHEN NOT contains(s, '{back}') THEN s WHEN NOT contains(s, '{anchor}') THEN {_REV.format('s')} END
WHEN coalesce(f.d, 99) < coalesce(b.d, 99) THEN s WHEN b.d < coalesce(f.d, 99) THEN {_REV.format('s')} END AS s FROM {source} r LEFT JOIN {name}_f f ON f.id = r.id LEFT JOIN {name}_b b ON b.id = r.id)"""


def after_sql(name: str, source: str, const: str, errors: int) -> str:
    return places_sql(f"{name}_p", source, const, errors) + f", {name} AS (SELECT r.id, CASE WHEN contains(s, '{const}') THEN list_last(string_split(s, '{const}')) WHEN length(s) > 0 THEN substr(s, p.last + 1) END AS s FROM {source} r LEFT JOIN {name}_p p ON p.id = r.id)"


def before_sql(name: str, source: str, const: str, errors: int) -> str:
    return places_sql(f"{name}_p", source, const, errors) + f", {name} AS (SELECT r.id, CASE WHEN contains(s, '{const}') THEN string_split(s, '{const}')[1] WHEN length(s) > 0 THEN substr(s, 1, p.start) END AS s FROM {source} r LEFT JOIN {name}_p p ON p.id = r.id)"


_EXTRACT = (
    _CONSTRUCTS + strand_sql("sp", "r", _PRE, 2) + strand_sql("ss", "r", _SUF, 2) + after_sql("a", "sp", _PRE, 2) + before_sql("b", "ss", _SUF, 2) + before_sql("c", "a", _SUF, 2)
    + " SELECT sp.id AS p_partkey, sp.s AS strand, nullif(left(a.s, 9), '') AS after, nullif(right(b.s, 9), '') AS before, nullif(c.s, '') AS \"both\" FROM sp JOIN ss USING (id) JOIN a USING (id) JOIN b USING (id) JOIN c USING (id)"
)


@query("k33_extract", _EXTRACT)
def k33_extract(t):
    return A.extracted(constructs(t), "s", ELEMENTS).select("p_partkey", F.col("both_read").alias("strand"), "after", "before", "both")


# Reads with two barcodes and an associate; the kind says what is wrong with them.

_C = ("ACGGTTACATGCAGTCAGTA", "TTGACCATGAGGCATCATTA", "CAGTACCGTTAGGACTTGCA", "GGATTCACTCGATACGATCT", "TCAACGGCATTCTAGCGTAC", "AGCCTATGTCAAGTGGTTCA")


def tagged(t):
    """Reads of lineitem: a barcode of the supplier, one of the line's flags, and the supplier's associate, each between constants."""
    key = F.col("l_suppkey")
    rows = spread(t.lineitem).select((F.col("l_orderkey") % 8).alias("kind"), (F.col("l_linenumber") + 5).cast("int").alias("e"), *[F.substring(S.derived_dna(k), 1, 20).alias(n) for n, k in (("a", key), ("b", F.concat("l_returnflag", "l_linestatus")), ("c", key + 5000000))])
    kind, e = F.col("kind"), F.col("e")
    # One step at a time: each uses the strings of the one before several times.
    rows = rows.withColumn("p", changed(F.lit(_C[0]), e, kind == 2)).withColumn("a", less(F.col("a"), e, kind == 3)).withColumn("c", changed(F.col("c"), e, kind.isin(4, 5)))
    rows = rows.withColumn("c", changed(F.col("c"), F.lit(2), kind == 5)).withColumn("b", F.when(kind == 6, F.reverse("b")).otherwise(F.col("b")))
    rows = rows.withColumn("c", changed(F.col("c"), F.lit(15), kind == 5))
    rows = rows.withColumn("s", F.concat(F.lit("GATC"), "p", "a", F.lit(_C[1] + "TTTT" + _C[2]), "b", F.lit(_C[3] + _C[4]), "c", F.lit(_C[5])))
    return settled(rows.select(F.when(kind == 7, F.substring("s", 1, 15)).when(kind == 4, S.reverse_complement(F.col("s"))).otherwise(F.col("s")).alias("s")))


def tuples(t):
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.substring(S.derived_dna(F.col("s_suppkey")), 1, 20).alias("barcode"), F.substring(S.derived_dna(F.col("s_suppkey") + 5000000), 1, 20).alias("associate"))
    modes = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("id")).distinct().select("id", F.substring(S.derived_dna(F.col("id")), 1, 20).alias("barcode"))
    elements = {"supplier": A.Element(_C[0], _C[1], 20, 1, 1), "mode": A.Element(_C[2], _C[3], 20, 1, 1)}
    packs = reads.packed(tagged(t), "s", 10)[0]
    return reads.counted_tuples(packs, elements, {"supplier": suppliers, "mode": modes}, {"supplier": A.Associate(_C[4], _C[5], 1, 1)})


# By how reads were made: kinds 0 to 4 are within the errors, 5 has three in its associate, 6 another barcode of the mode, 7 is cut.
@query("s_read_tuples", "SELECT CAST(l_suppkey AS VARCHAR) AS supplier, CASE WHEN l_orderkey % 8 = 6 THEN '-' ELSE l_returnflag || l_linestatus END AS mode, count(*) AS n FROM lineitem WHERE l_orderkey % 8 NOT IN (5, 7) GROUP BY 1, 2")
def read_tuples(t):
    return tuples(t)[0]


@query("s_tuple_outcomes", "SELECT CASE l_orderkey % 8 WHEN 5 THEN 'associate' WHEN 7 THEN 'no anchor' ELSE 'counted' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1")
def tuple_outcomes(t):
    return tuples(t)[1]


@query("j16_associates", f"WITH d AS (SELECT p_partkey, p_partkey % 5 AS k, {DNA.format('p_partkey')} AS s FROM part), a AS (SELECT *, substr(s, 9, 12) AS a FROM d), r AS (SELECT *, " + less_sql("(" + changed_sql("a", "4", "k >= 1") + ")", "9", "k >= 2") + " AS x FROM a), q AS (SELECT *, " + changed_sql("x", "2", "k >= 3") + " AS y FROM r), m AS (SELECT p_partkey, min(levenshtein(y, substr(s, i, n))) AS d FROM q, range(1, 33) a(i), range(8, 16) b(n) WHERE i + n <= 33 GROUP BY 1) SELECT p_partkey, d <= 2 AS matched FROM m")
def j16(t):
    k, s = F.col("p_partkey") % 5, S.derived_dna(F.col("p_partkey"))
    a = F.substring(s, 9, 12)
    a = changed(less(changed(a, F.lit(4), k >= 1), F.lit(9), k >= 2), F.lit(2), k >= 3)
    return fuzzy.associate_matches(t.part.select("p_partkey", s.alias("s"), a.alias("a")), "s", "a", 2).select("p_partkey", "matched")


# Repeats of any length, by comparing all substrings.

_ALL = """WITH d AS (SELECT p_partkey, {s} AS s FROM part), b AS ({strands}),
x AS (SELECT p_partkey, strand, i, n, substr(s, i, n) AS w, CASE WHEN i > 1 THEN substr(s, i - 1, 1) ELSE '^' END AS b, CASE WHEN i + n <= length(s) THEN substr(s, i + n, 1) ELSE '$' END AS a, CASE strand WHEN 0 THEN i ELSE length(s) - i - n + 2 END AS place FROM b, range(1, 60) t(i), range({k}, 60) u(n) WHERE i + n <= length(s) + 1),
g AS (SELECT w, count(DISTINCT p_partkey) AS n_rows, count(DISTINCT (p_partkey, place)) AS n, count(DISTINCT b) > 1 OR min(b) = '^' OR max(b) = '^' AS l, count(DISTINCT a) > 1 OR min(a) = '$' AS r FROM x GROUP BY w)
SELECT w AS repeat, length(w)::INTEGER AS length, n_rows, n FROM g WHERE n > 1 AND l AND r{canonical}"""
# Every fifth part begins with the end of another one, every seventh with its other strand.
_MIXED = f"CASE WHEN p_partkey % 5 = 0 THEN substr({DNA.format('p_partkey + 1')}, 9, 24) || substr({DNA.format('p_partkey')}, 1, 8 + CAST(p_partkey % 3 AS INT)) WHEN p_partkey % 7 = 0 THEN {_REV.format(f"substr({DNA.format('p_partkey + 3')}, 1, 20)")} || substr({DNA.format('p_partkey')}, 1, 20) ELSE {DNA.format('p_partkey')} END"


def mixed_parts(t):
    key = F.col("p_partkey")
    d = S.derived_dna(key)
    other = F.concat(F.substring(S.derived_dna(key + 1), 9, 24), F.substring(d, F.lit(1), (8 + key % 3).cast("int")))
    turned = F.concat(S.reverse_complement(F.substring(S.derived_dna(key + 3), 1, 20)), F.substring(d, 1, 20))
    return t.part.select("p_partkey", F.when(key % 5 == 0, other).when(key % 7 == 0, turned).otherwise(d).alias("s"))


@query("k19_repeats_direct", _ALL.format(s=_MIXED, k=9, strands="SELECT *, 0 AS strand FROM d", canonical=""))
def k19_direct(t):
    return kmers.repeats(mixed_parts(t), "p_partkey", F.col("s"), 9, both=False)


@query("k39_repeats_both_strands", _ALL.format(s=_MIXED, k=10, strands=f"SELECT *, 0 AS strand FROM d UNION ALL SELECT p_partkey, {_REV.format('s')}, 1 FROM d", canonical=f" AND w <= {_REV.format('w')}"))
def k39_both(t):
    return kmers.repeats(mixed_parts(t), "p_partkey", F.col("s"), 10)


# A made part for each supplier, clear of all parts; what is wrong with each is counted anew from the k-mers.

MADE = "NNNNNNNNSWNNNNNNNNNNWSNNNNNNNN"


@query("d10_made_parts", "SELECT s_suppkey AS id, 30 AS length, TRUE AS legal, 0::BIGINT AS shared, 0::BIGINT AS known FROM supplier")
def d10(t):
    asked = maker.numbered(t.supplier.select("s_suppkey"), "s_suppkey")
    known = kmers.background(kmers.exploded(t.part.select("p_partkey", S.derived_dna(F.col("p_partkey")).alias("s")), "p_partkey", F.col("s"), 12, "canonical"))
    made = maker.made_parts(t.spark, MADE, t.supplier.count(), 12, known, local=lambda s: "GGGG" not in s[-4:])
    told = maker.verified(made, "id", "part", MADE, 12, known)
    return asked.join(told, "id").select(F.col("s_suppkey").alias("id"), "length", "legal", "shared", "known")


_VERIFIED = f"""WITH p AS (SELECT p_partkey, {DNA.format('p_partkey')} AS s FROM part), u AS (SELECT s_suppkey, substr({DNA.format('s_suppkey % 40')}, 1, 20) AS s FROM supplier),
canon AS (SELECT s_suppkey, least(substr(s, i, 8), {_REV.format('substr(s, i, 8)')}) AS kmer FROM u, range(1, 14) t(i)), b AS (SELECT DISTINCT least(substr(s, i, 8), {_REV.format('substr(s, i, 8)')}) AS kmer FROM p, range(1, 26) t(i)),
n AS (SELECT kmer, count(*) AS n FROM canon GROUP BY 1), x AS (SELECT c.s_suppkey, c.kmer, max(n.n > 1) AS shared, max(b.kmer IS NOT NULL) AS known FROM canon c JOIN n USING (kmer) LEFT JOIN b USING (kmer) GROUP BY 1, 2)
SELECT u.s_suppkey, length(s)::INTEGER AS length, regexp_matches(s, '^[ACGT]{{10}}[CG][ACGT]{{9}}$') AS legal, count(*) FILTER (WHERE shared) AS shared, count(*) FILTER (WHERE known) AS known FROM u LEFT JOIN x USING (s_suppkey) GROUP BY ALL"""


@query("d16_verified_parts", _VERIFIED)
def d16(t):
    known = kmers.background(kmers.exploded(t.part.select("p_partkey", S.derived_dna(F.col("p_partkey")).alias("s")), "p_partkey", F.col("s"), 8, "canonical"))
    asked = t.supplier.select("s_suppkey", F.substring(S.derived_dna(F.col("s_suppkey") % 40), 1, 20).alias("s"))
    return maker.verified(asked, "s_suppkey", "s", "N" * 10 + "S" + "N" * 9, 8, known)


QUERIES, ORACLE = group.queries, group.sql
