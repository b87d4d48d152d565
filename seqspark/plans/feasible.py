"""Queries of feasibility: structures, regions, stores, budgets, enzymes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constraints as C
from ..functions import sequences as S
from ..operators import cuts, design, fuzzy, kmers
from .base import Group, spread

group = Group()
query = group.query
DNA = "translate(md5(CAST({} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
PART = f"d AS (SELECT p_partkey, {DNA.format('p_partkey')} AS s FROM part)"
#: Two stems around a loop, parted on the left where the key isn't divisible by 3.
STRUCTURE = "s AS (SELECT p_partkey, 1 + p_partkey % 5 AS a, p_partkey % 3 AS g, 1 + p_partkey % 4 AS c, 3 + p_partkey % 6 AS b FROM part)"


def dna(t):
    return spread(t.part.select("p_partkey")).select("p_partkey", S.derived_dna(F.col("p_partkey")).alias("s"))


def structures(t):
    of = lambda letter, n: F.repeat(F.lit(letter), n.cast("int"))
    k = F.col("p_partkey")
    a, g, c, b = 1 + k % 5, k % 3, 1 + k % 4, 3 + k % 6
    return spread(t.part.select("p_partkey")).select("p_partkey", F.concat(F.lit(".."), of("(", a), of(".", g), of("(", c), of(".", b), of(")", c), of(")", a)).alias("s"))


@query("f28_stem_conflicts", f"WITH {STRUCTURE}, r AS (SELECT p_partkey, 3 AS i, 2 + 2 * a + g + 2 * c + b AS j, CASE WHEN g = 0 THEN a + c ELSE a END AS n FROM s UNION ALL SELECT p_partkey, 3 + a + g, 2 + a + g + 2 * c + b, c FROM s WHERE g > 0) SELECT p_partkey, i::INT AS i, j::INT AS j, n::INT AS n FROM r WHERE n >= 4")
def f28(t):
    return structures(t).select("p_partkey", F.inline(C.stem_conflicts(F.col("s"), 4)))


@query("m13_kinetic_score", f"WITH {STRUCTURE} SELECT p_partkey, round((2 * a + g + 2 * c + b - 1) / (2 + 2 * a + g + 2 * c + b), 9) AS score, round(pow(2 * a + g + 2 * c + b - 1, -1.44), 9) AS chance FROM s")
def m13(t):
    return structures(t).select("p_partkey", C.kinetic_score(F.col("s")).alias("k")).select("p_partkey", F.round("k.score", 9).alias("score"), F.round("k.chance", 9).alias("chance"))


_CASE = {name: " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) for name, table in (("p", S.PERSISTENCE), ("d", S.DNA_STACKING), ("r", S.RNA_STACKING))}


@query("m03_stacking", f"WITH {PART}, x AS (SELECT p_partkey, i, substr(s, i, 2) AS m FROM (SELECT *, unnest(range(1, 32, 2)) AS i FROM d)) SELECT p_partkey, round(sum((CASE m {_CASE['p']} END)::DOUBLE) / 32, 6) AS rigidity, round(2 * sum((CASE m {_CASE['d']} END)::DOUBLE), 6) AS bubble, round(sum((CASE m {_CASE['d']} END)::DOUBLE) FILTER (i < 15), 6) AS dna, round(sum((CASE m {_CASE['r']} END)::DOUBLE) FILTER (i < 15), 6) AS rna FROM x GROUP BY 1")
def m03(t):
    out = dna(t).select("p_partkey", S.rigidity(F.col("s")).alias("r"), S.bubble_energy(F.col("s")).alias("b"), S.hybrid_energies(F.col("s")).alias("h"))
    return out.select("p_partkey", F.round("r", 6).alias("rigidity"), F.round("b", 6).alias("bubble"), F.round("h.dna", 6).alias("dna"), F.round("h.rna", 6).alias("rna"))


@query("f35_motifs_within", f"WITH {PART}, m AS (SELECT unnest(['GATC', 'ACGT', 'TTT']) AS motif), e AS (SELECT p_partkey, 'CCGA' AS l, substr(s, 1, 12) AS s, 'TTGG' AS r FROM d) SELECT p_partkey, motif FROM e, m WHERE contains(right(l, length(motif) - 1) || s || left(r, length(motif) - 1), motif)")
def f35(t):
    motifs = F.array(*map(F.lit, ("GATC", "ACGT", "TTT")))
    return dna(t).select("p_partkey", F.explode(C.motifs_within(F.substring("s", 1, 12), F.lit("CCGA"), F.lit("TTGG"), motifs)).alias("motif"))


@query("f39_sites_within", f"WITH {PART}, e AS (SELECT unnest(['BsaI', 'BsmBI', 'BbsI', 'BspMI', 'SapI']) AS enzyme, unnest(['GGTCTC', 'CGTCTC', 'GAAGAC', 'ACCTGC', 'GCTCTTC']) AS site), x AS (SELECT p_partkey, enzyme, count(*) FILTER (substr(s, i, length(site)) = site) AS forward, count(*) FILTER (substr(s, i, length(site)) = reverse(translate(site, 'ACGT', 'TGCA'))) AS reverse FROM (SELECT *, unnest(range(1, 33)) AS i FROM d), e GROUP BY ALL) SELECT * FROM x WHERE forward + reverse > 0")
def f39(t):
    enzymes = [("BsaI", "GGTCTC"), ("BsmBI", "CGTCTC"), ("BbsI", "GAAGAC"), ("BspMI", "ACCTGC"), ("SapI", "GCTCTTC")]
    return design.sites_within(dna(t), F.col("s"), enzymes).select("p_partkey", "enzyme", F.size("forward").cast("long").alias("forward"), F.size("reverse").cast("long").alias("reverse"))


@query("f40_splittable", "SELECT p_partkey, (x + 10 <= 40 AND 30 + y - x - 10 + 20 <= 40 AND 30 + y + 20 - 10 + 40 >= 100) AS feasible FROM (SELECT p_partkey, p_partkey % 40 AS x, p_partkey % 7 * 4 AS y FROM part)")
def f40(t):
    k = F.col("p_partkey")
    x, y = (k % 40).cast("int"), (k % 7 * 4).cast("int")
    region = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return t.part.select("p_partkey", C.splittable(F.array(region(x, x + 10), region(30 + y, 50 + y)), F.lit(100), 40, 10).alias("feasible"))


# Two stretches of 32 letters that differ between parts, between three that all have in common.
_COMMON = ("ACGTTGCAACGGTACCATGC", "GGATCCTTAGCA", "TTGACCTAGGCATGCAATCG")
_VARIANT = f"v AS (SELECT p_partkey, '{_COMMON[0]}' || {DNA.format('p_partkey')} || '{_COMMON[1]}' || {DNA.format('p_partkey + 1000003')} || '{_COMMON[2]}' AS s FROM part)"


def variants(t):
    k = F.col("p_partkey")
    return spread(t.part.select("p_partkey")).select("p_partkey", F.concat(F.lit(_COMMON[0]), S.derived_dna(k), F.lit(_COMMON[1]), S.derived_dna(k + 1000003), F.lit(_COMMON[2])).alias("s"))


@query("a11_variable_regions", f"WITH {_VARIANT}, c AS (SELECT i, substr(s, i + 1, 1) AS c, count(*) AS n FROM (SELECT s, unnest(range(116)) AS i FROM v) GROUP BY ALL), e AS (SELECT i, -sum(n / t * log(n / t)) / log(4) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY i) AS t FROM c) GROUP BY 1), r AS (SELECT i, i - row_number() OVER (ORDER BY i) AS run FROM e WHERE e > 0.25) SELECT min(i)::INT AS start, max(i)::INT + 1 AS \"end\" FROM r GROUP BY run HAVING count(*) >= 15")
def a11_regions(t):
    return cuts.variable_regions(cuts.column_entropy(variants(t), "s"), 0, 15)


_H = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.NEAREST_ENTHALPY.items())
_S = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.NEAREST_ENTROPY.items())


@query("n11_window_melting", f"WITH {_VARIANT}, p AS (SELECT p_partkey, j, sum(CASE substr(s, j, 2) {_H} END) OVER w AS h, sum(CASE substr(s, j, 2) {_S} END) OVER w AS e FROM (SELECT *, unnest(range(1, 116)) AS j FROM v) WINDOW w AS (PARTITION BY p_partkey ORDER BY j)), m AS (SELECT b.j + 1 AS q, w, min((b.h - coalesce(a.h, 0)) * 1000 / (b.e - coalesce(a.e, 0) + 0.368 * ln(0.05) * (w - 1) + 1.987 * ln(5e-8 / 4)) - 273.15) AS m FROM p b CROSS JOIN range(15, 19) x(w) LEFT JOIN p a ON a.p_partkey = b.p_partkey AND a.j = b.j - w + 1 WHERE b.j + 1 >= w GROUP BY 1, 2) SELECT q, w, round(m, 6) AS melting FROM m")
def n11_melting(t):
    return cuts.least_melting(variants(t), "s", 116, 15, 18).select("q", "w", F.round("melting", 6).alias("melting"))


@query("d05_shared_split")
def d05_shared(t):
    split, status = cuts.split_shared(variants(t), "s", 60, 30.0, 2, 15, 25)
    if split is None:
        raise ValueError(status["reason"])
    return split.select("p_partkey", F.posexplode("fragments").alias("i", "fragment"))


@query("a39_split_statistics", f"WITH {PART}, f AS (SELECT p_partkey, i, substr(s, (i * 10 + 1)::INT, 20) AS piece, CASE WHEN i < 2 THEN substr(s, (i * 10 + 11)::INT, 10) END AS o FROM (SELECT *, unnest(range(3)) AS i FROM d)), m AS (SELECT p_partkey, i, sum(CASE substr(o, j, 2) {_H} END) * 1000 / (sum(CASE substr(o, j, 2) {_S} END) + 0.368 * ln(0.05) * 9 + 1.987 * ln(5e-8 / 4)) - 273.15 AS tm FROM (SELECT *, unnest(range(1, 10)) AS j FROM f WHERE o IS NOT NULL) GROUP BY 1, 2) SELECT i::INT AS i, min(length(piece))::INT AS least, count(*) AS n, round(avg(tm), 6) AS melting, count(DISTINCT o) AS kinds FROM f LEFT JOIN m USING (p_partkey, i) GROUP BY 1")
def a39(t):
    return design.split_statistics(dna(t), F.col("s"), 20, 10).withColumn("melting", F.round("melting", 6))


@query("a40_capacity", "SELECT 524288::BIGINT AS space, sum(CASE WHEN length(p_name) <= 10 THEN 1 ELSE (length(p_name) - 9) * p_size END)::BIGINT AS needed, sum(CASE WHEN length(p_name) <= 10 THEN 1 ELSE (length(p_name) - 9) * p_size END) <= 524288 AS enough FROM part")
def a40(t):
    return kmers.capacity(t.part, F.length("p_name"), F.col("p_size"), 10)


def _words(key, table, k=5):
    return f"SELECT DISTINCT substr({DNA.format(key)}, i, {k}) AS kmer FROM (SELECT *, unnest(range(1, {34 - k})) AS i FROM {table})"


@query("j19_kmer_store", f"WITH p AS ({_words('n_nationkey', 'nation')}), q AS ({_words('r_regionkey + 500', 'region')}), g AS ({_words('n_nationkey + 90', 'nation')}), st AS (SELECT kmer FROM (SELECT * FROM p UNION SELECT * FROM q) WHERE kmer NOT IN (SELECT kmer FROM g)), s AS ({_words('s_suppkey', 'supplier')}) SELECT kmer, kmer IN (SELECT kmer FROM st) AS known FROM s")
def j19(t):
    words = lambda df, key: kmers.background(kmers.exploded(df.select(key.alias("k")), "k", S.derived_dna(F.col("k")), 5))
    store = kmers.added(words(t.nation, F.col("n_nationkey")), words(t.region, F.col("r_regionkey") + 500))
    store = kmers.removed(store, words(t.nation, F.col("n_nationkey") + 90))
    return kmers.checked(store, words(t.supplier, F.col("s_suppkey")))


@query("x02_budgets", "SELECT p_partkey, least(greatest(t, 0), p_size % 7)::INT AS substrings, (CASE WHEN t >= n / 2 THEN n // 2 ELSE greatest(t, 0) END)::INT AS patterns FROM (SELECT p_partkey, p_size, (p_partkey % 15 - 4)::INT AS t, (8 + p_size % 5)::INT AS n FROM part)")
def x02(t):
    errors = (F.col("p_partkey") % 15 - 4).cast("int")
    got = fuzzy.budgets(errors, (F.col("p_size") % 7).cast("int"), (8 + F.col("p_size") % 5).cast("int"))
    return t.part.select("p_partkey", got.alias("b")).select("p_partkey", "b.*")


QUERIES, ORACLE = group.queries, group.sql
