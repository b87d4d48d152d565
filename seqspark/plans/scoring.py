"""Queries of scalar functions, rules, model scores and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import design, kmers, rules, scoring
from .base import Group, kept, spread

group = Group()
query = group.query
DNA = "translate(md5(CAST({} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
PART = f"d AS (SELECT p_partkey, {DNA.format('p_partkey')} AS s FROM part)"
REV = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def dna(t):
    return spread(t.part.select("p_partkey")).select("p_partkey", S.derived_dna(F.col("p_partkey")).alias("s"))


@query("k02_reverse_complement", f"WITH {PART} SELECT p_partkey, {REV.format('s')} AS r FROM d")
def k02(t):
    return dna(t).select("p_partkey", S.reverse_complement(F.col("s")).alias("r"))


@query("k03_canonical", f"WITH {PART}, k AS (SELECT least(substr(s, i, 6), {REV.format('substr(s, i, 6)')}) AS kmer FROM (SELECT *, unnest(range(1, 28)) AS i FROM d)) SELECT kmer, count(*) AS n FROM k GROUP BY 1")
def k03(t):
    return dna(t).select(F.explode(F.transform(S.kmers(F.col("s"), 6), S.canonical)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query("k04_contigs", f"WITH {PART} SELECT p_partkey, u.i::INT AS i, u.c AS contig FROM (SELECT p_partkey, unnest([{{'i': 0, 'c': substr(s, 1, 8)}}, {{'i': 1, 'c': substr(s, 9, 12)}}, {{'i': 2, 'c': substr(s, 21, 12)}}]) AS u FROM d)")
def k04(t):
    return dna(t).select("p_partkey", F.inline(S.contigs(F.col("s"), [8, 12, 12])))


@query("k05_substrings", f"WITH {PART} SELECT length(x)::BIGINT AS n, count(*) AS pieces, count(DISTINCT x) AS kinds FROM (SELECT substr(s, i, w) AS x FROM (SELECT s, w, unnest(range(1, 34 - w)) AS i FROM (SELECT *, unnest([4, 5, 6]) AS w FROM d))) GROUP BY 1")
def k05(t):
    x = dna(t).select(F.explode(S.substrings(F.col("s"), 4, 6)).alias("x"))
    return x.groupBy(F.length("x").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("x").alias("kinds"))


@query("k06_hamming", f"SELECT p_partkey, CASE WHEN h <= 24 THEN h END::BIGINT AS h FROM (SELECT p_partkey, hamming({DNA.format('p_partkey')}, {DNA.format('p_partkey + 1')}) AS h FROM part)")
def k06(t):
    return t.part.select("p_partkey", S.bounded_hamming(S.derived_dna(F.col("p_partkey")), S.derived_dna(F.col("p_partkey") + 1), 24).cast("long").alias("h"))


@query("k07_edit_distance", "SELECT n_nationkey, r_name, CASE WHEN levenshtein(n_name, r_name) <= 7 THEN levenshtein(n_name, r_name) END AS d FROM nation, region")
def k07(t):
    d = F.levenshtein("n_name", "r_name", 7)
    return t.nation.crossJoin(F.broadcast(t.region)).select("n_nationkey", "r_name", F.when(d >= 0, d).cast("long").alias("d"))


@query("k08_splits", f"SELECT substr(m, 1, i::INT) AS prefix, array_to_string(list_sort(list(substr(m, i::INT + 1))), ',') AS suffixes FROM (SELECT m, unnest(range(1, 6)) AS i FROM (SELECT DISTINCT substr({DNA.format('n_nationkey')}, 1, 6) AS m FROM nation)) GROUP BY 1")
def k08(t):
    m = t.nation.select(F.substring(S.derived_dna(F.col("n_nationkey")), 1, 6).alias("m")).distinct()
    cut = m.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5)))).select(F.expr("substring(m, 1, i)").alias("prefix"), F.expr("substring(m, i + 1)").alias("suffix"))
    return cut.groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_list("suffix")), ",").alias("suffixes"))


@query("k10_tolerance", "SELECT DISTINCT length(p_name)::BIGINT AS n, CASE WHEN length(p_name) <= 8 THEN 0 WHEN length(p_name) <= 15 THEN 1 ELSE (length(p_name) - 1) // 5 - 1 END::BIGINT AS t FROM part")
def k10(t):
    n = F.length("p_name")
    return t.part.select(n.cast("long").alias("n"), S.tolerated_mismatches(n).alias("t")).distinct()


_CON = "translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTNRYN')"


def constraints(t):
    return t.customer.select("c_custkey", F.translate(F.md5(F.col("c_custkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTNRYN").alias("s"))


@query("k11_regions", f"SELECT c_custkey, array_to_string(list_sort(list_distinct(regexp_extract_all({_CON}, '[ACGT]+'))), ',') AS regions FROM customer")
def k11(t):
    return constraints(t).select("c_custkey", F.array_join(S.constant_regions(F.col("s")), ",").alias("regions"))


@query("k21_degeneracy", f"SELECT c_custkey, pow(4, length(s) - length(replace(s, 'N', ''))) * pow(2, length(s) - length(regexp_replace(s, '[RY]', '', 'g'))) AS n FROM (SELECT c_custkey, {_CON} AS s FROM customer)")
def k21(t):
    return constraints(t).select("c_custkey", S.degeneracy(F.col("s")).alias("n"))


@query("k15_palindromes", f"WITH {PART}, k AS (SELECT p_partkey, substr(s, i, 6) AS k FROM (SELECT *, unnest(range(1, 28)) AS i FROM d)) SELECT p_partkey, count(*) AS n FROM k WHERE k = {REV.format('k')} GROUP BY 1")
def k15(t):
    k = dna(t).select("p_partkey", F.explode(S.kmers(F.col("s"), 6)).alias("k"))
    return k.where(F.col("k") == S.reverse_complement(F.col("k"))).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"))


_B4 = "array_to_string([substr('AGTC', ((x // pow(4, {w} - 1 - j)::BIGINT) % 4)::INT + 1, 1) for j in range({w})], '')"


@query("k17_base4", f"SELECT n, {_B4.format(w=8).replace('x //', 'n //')} AS s FROM (SELECT p_partkey % 65536 AS n FROM part)")
def k17(t):
    return t.part.select((F.col("p_partkey") % 65536).alias("n")).select("n", S.from_number(F.col("n"), 8).alias("s"))


@query("k18_walk", "SELECT n, count(*) AS times FROM range(4096) r(n) GROUP BY 1")
def k18(t):
    return design.walk(t.spark, 6).groupBy("n").agg(F.count(F.lit(1)).alias("times"))


@query("k22_multimers", f"SELECT n, {_B4.format(w=6).replace('x //', 'n //')} AS s FROM range(4096) r(n)")
def k22(t):
    return design.multimers(t.spark, 6)


@query("k23_kmer_index", f"WITH {PART} SELECT k, count(*) AS n, min(e)::BIGINT AS first FROM (SELECT substr(s, i, 4) AS k, i + 3 AS e FROM (SELECT *, unnest(range(1, 30)) AS i FROM d)) GROUP BY 1")
def k23(t):
    at = dna(t).select(F.posexplode(S.kmers(F.col("s"), 4)).alias("i", "k"))
    return at.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("i") + 4).cast("long").alias("first"))


@query("k24_adjacent_targets", f"WITH {PART} SELECT p_partkey, substr(s, i - 8, 8) AS target, (i - 8)::BIGINT AS at FROM (SELECT *, unnest(range(9, 32)) AS i FROM d) WHERE substr(s, i + 1, 2) = 'GG' AND i <= 30")
def k24(t):
    i = dna(t).withColumn("i", F.explode(F.sequence(F.lit(9), F.lit(30))))
    hit = i.where(F.substring("s", F.col("i") + 1, F.lit(2)) == "GG")
    return hit.select("p_partkey", F.substring("s", F.col("i") - 8, F.lit(8)).alias("target"), (F.col("i") - 8).cast("long").alias("at"))


_STEP = " + ".join(f"CASE substr(s, {i}, 2) WHEN 'AA' THEN -5.37 WHEN 'CG' THEN -9.69 WHEN 'GC' THEN -14.59 ELSE 0 END" for i in range(1, 32, 2))


@query("m02_dinucleotides", f"WITH {PART} SELECT p_partkey, round({_STEP}, 4)::DOUBLE AS e FROM d")
def m02(t):
    return dna(t).select("p_partkey", F.round(S.pair_sum(F.col("s"), {"AA": -5.37, "CG": -9.69, "GC": -14.59}, 2), 4).alias("e"))


#: A table of coefficients as a user would give it: letters of a box and their energies.
BOX = {"TTG": -1.0, "ACA": -0.8, "TAT": -1.2, "AAT": -0.6, "GGC": 0.9, "CGC": 0.7}
_BOX = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BOX.items()) + " ELSE 0 END"


@query(
    "m04_linear_model",
    f"WITH {PART}, c AS (SELECT p_partkey, s, sp, di, unnest(range(1, 32 - (6 + sp + 6 + di) + 2)) AS p FROM (SELECT *, unnest([3, 4, 5]) AS di FROM (SELECT *, unnest([8, 9, 10]) AS sp FROM d))), e AS (SELECT *, {_BOX.format('substr(s, p, 3)')} + {_BOX.format('substr(s, p + 3, 3)')} + {_BOX.format('substr(s, p + 6 + sp, 3)')} + {_BOX.format('substr(s, p + 9 + sp, 3)')} + 0.1 * (sp - 9) * (sp - 9) + 0.05 * di AS g FROM c) SELECT p_partkey, round(min(g), 6)::DOUBLE AS g, round(exp(-min(g)), 6) AS rate, count(*) AS n FROM e GROUP BY 1",
)
def m04(t):
    c = scoring.configurations(dna(t), F.length("s"), range(8, 11), range(3, 6), 6, 6)
    piece = lambda shift: F.substring("s", F.col("at") + shift, F.lit(3))
    boxes = scoring.lookup_sum([piece(F.lit(0)), piece(F.lit(3)), piece(6 + F.col("spacer")), piece(9 + F.col("spacer"))], [BOX] * 4)
    g = boxes + 0.1 * (F.col("spacer") - 9) * (F.col("spacer") - 9) + 0.05 * F.col("disc")
    out = c.withColumn("g", g).groupBy("p_partkey").agg(F.min("g").alias("g"), F.count(F.lit(1)).alias("n"))
    return out.select("p_partkey", F.round("g", 6).alias("g"), F.round(scoring.rate(F.col("g")), 6).alias("rate"), "n")


@query("m07_spacing", "SELECT d::BIGINT AS d, round(CASE WHEN d < 5 THEN 12.2 / pow(1 + exp(2.5 * (d - 3)), 3) WHEN d > 5 THEN 0.048 * (d - 5) * (d - 5) + 0.24 * (d - 5) ELSE 0 END, 6) AS penalty FROM range(1, 13) r(d)")
def m07(t):
    return t.spark.range(1, 13).select(F.col("id").alias("d"), F.round(S.spacing_penalty(F.col("id")), 6).alias("penalty"))


@query("m08_expression", f"WITH {PART}, m AS (SELECT substr(s, 1, 3) AS k, min(p_partkey) / 100.0 AS v FROM d WHERE p_partkey % 3 = 0 GROUP BY 1), e AS (SELECT substr(s, 1, 3) AS k, min(p_partkey) / 200.0 AS v FROM d GROUP BY 1) SELECT p_partkey, round(coalesce(m.v, e.v), 6)::DOUBLE AS v, m.v IS NOT NULL AS measured FROM d LEFT JOIN m ON substr(s, 1, 3) = m.k LEFT JOIN e ON substr(s, 1, 3) = e.k")
def m08(t):
    d = dna(t).withColumn("k", F.substring("s", 1, 3))
    table = lambda df, by, name: df.groupBy("k").agg((F.min("p_partkey") / by).alias(name))
    both = d.join(table(d.where("p_partkey % 3 = 0"), 100.0, "m"), "k", "left").join(table(d, 200.0, "e"), "k", "left")
    return both.select("p_partkey", F.round(F.coalesce("m", "e"), 6).alias("v"), F.col("m").isNotNull().alias("measured"))


@query("m09_best_spacing", f"WITH {PART} SELECT p_partkey, max(v)::DOUBLE AS v, arg_max(o, (v, -o))::BIGINT AS o FROM (SELECT p_partkey, o, (length(s) - length(replace(substr(s, 1, 20 + o), 'A', '')) - (32 - (20 + o))) - abs(o - 5) * 0.5 AS v FROM (SELECT *, unnest(range(12)) AS o FROM d)) GROUP BY 1")
def m09(t):
    # The best of a row is found within it, so a row, not each of its spacings, goes on to the rows of its key.
    head = lambda o: F.substring("s", F.lit(1), 20 + o)
    v = lambda o: (F.length("s") - F.length(F.replace(head(o), F.lit("A"), F.lit(""))) - (32 - (20 + o))) - F.abs(o - 5) * 0.5
    own = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda o: F.struct(v(o).cast("double").alias("v"), (-o).alias("o"))))
    best = dna(t).select("p_partkey", own.alias("b")).groupBy("p_partkey").agg(F.max("b").alias("b"))
    return best.select("p_partkey", F.col("b.v").alias("v"), (-F.col("b.o")).cast("long").alias("o"))


@query("m10_exchange", f"SELECT p_partkey, round({' + '.join(f'CASE WHEN substr(a, {i}, 1) <> substr(b, {i}, 1) THEN 2.3 * {i / 10} ELSE 0 END' for i in range(1, 11))}, 6)::DOUBLE AS e FROM (SELECT p_partkey, {DNA.format('p_partkey')} AS a, {DNA.format('p_partkey + 7')} AS b FROM part)")
def m10(t):
    return t.part.select("p_partkey", F.round(scoring.mismatch_energy(S.derived_dna(F.col("p_partkey")), S.derived_dna(F.col("p_partkey") + 7), [i / 10 for i in range(1, 11)]), 6).alias("e"))


@query("m11_safe_functions", "SELECT p_partkey, coalesce(p_retailprice / nullif(p_size - 10, 0), 0) AS q, CASE WHEN p_size - 10 > 0 THEN round(ln(p_size - 10), 9) ELSE 0 END AS l FROM part")
def m11(t):
    return t.part.select("p_partkey", S.safe_divide(F.col("p_retailprice"), F.col("p_size") - 10).alias("q"), F.round(S.safe_log((F.col("p_size") - 10).cast("double")), 9).alias("l"))


@query("r01_runs", f"WITH {PART} SELECT p_partkey, {', '.join(f'len(regexp_extract_all(s, {chr(39)}{c}{{3,}}{chr(39)}))::BIGINT AS {c.lower()}' for c in 'ACGT')}, len(regexp_extract_all(s, 'G{{3,}}(?:[ACGT]{{1,7}}G{{3,}}){{2,}}'))::BIGINT AS quadruplex FROM d".replace("{{", "{").replace("}}", "}"))
def r01(t):
    n = rules.run_counts(F.col("s"), 3)
    return dna(t).select("p_partkey", *[n[c].alias(c.lower()) for c in "ACGT"], rules.quadruplex(F.col("s")).alias("quadruplex"))


@query("r03_slippage", f"WITH {PART} SELECT p_partkey, len(list_filter(range(1, 12), lambda i: contains(substr(h, i + 5, 15), substr(h, i, 5)) OR contains(substr(h, i + 5, 15), {REV.format('substr(h, i, 5)')}))) > 0 AS slips FROM (SELECT p_partkey, left(s, 15) AS h FROM d)")
def r03(t):
    return dna(t).select("p_partkey", rules.terminal_slippage(F.col("s")).alias("slips"))


@query("r04_hairpins", f"WITH {PART} SELECT p_partkey, count(*) AS n, min(i)::BIGINT AS first FROM (SELECT p_partkey, s, l, unnest(range(1, 32 - 10 - l + 2)) AS i FROM (SELECT *, unnest([3, 4, 5, 6]) AS l FROM d)) WHERE substr(s, i, 5) = {REV.format('substr(s, i + 5 + l, 5)')} GROUP BY 1")
def r04(t):
    h = dna(t).select("p_partkey", rules.hairpins(F.col("s"), 5, (3, 6)).alias("h"))
    row = F.struct(F.size("h").cast("long").alias("n"), F.array_min(F.transform("h", lambda x: x["at"])).cast("long").alias("first"))
    return kept(h, "p_partkey", row, lambda x: x["n"] > 0)


@query("r05_tandem", f"WITH {PART} SELECT p_partkey, count(*) AS n FROM (SELECT *, unnest(range(1, 28)) AS i FROM d) WHERE substr(s, i, 3) = substr(s, i + 3, 3) GROUP BY 1")
def r05(t):
    h = dna(t).select("p_partkey", rules.tandem(F.col("s"), 3).alias("h"))
    return kept(h, "p_partkey", F.struct(F.size("h").cast("long").alias("n")), lambda x: x["n"] > 0)


@query("r06_verdict", f"WITH {PART} SELECT p_partkey, NOT list_bool_or([NOT (length(regexp_replace(substr(s, i, 20), '[^GC]', '', 'g')) / 20.0 > 0.15 AND length(regexp_replace(substr(s, i, 20), '[^GC]', '', 'g')) / 20.0 < 0.9) for i in range(1, 14)]) AND NOT regexp_matches(substr(s, 2, 30), 'A{{13,}}|C{{9,}}|G{{9,}}|T{{13,}}') AND len(list_filter(range(1, 12), lambda i: contains(substr(left(s, 15), i + 5, 15), substr(s, i, 5)) OR contains(substr(left(s, 15), i + 5, 15), {REV.format('substr(s, i, 5)')}))) = 0 AS passes FROM d")
def r06(t):
    return dna(t).select("p_partkey", rules.verdict(F.col("s")).alias("passes"))


@query("r07_repeat_features", f"WITH {PART}, k AS (SELECT p_partkey, substr(s, i, 4) AS k, count(*) AS n FROM (SELECT *, unnest(range(1, 30)) AS i FROM d) GROUP BY 1, 2) SELECT p_partkey, max(n) AS most, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS repeated, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS density FROM k GROUP BY 1")
def r07(t):
    k = kmers.repeated_within(dna(t), "p_partkey", F.col("s"), lambda s: S.kmers(s, 4)).where("size > 0")
    again = F.aggregate("again", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    most = F.greatest(F.lit(1).cast("long"), F.coalesce(F.array_max(F.transform("again", lambda x: x["n"])), F.lit(0).cast("long")))
    return k.select("p_partkey", most.alias("most"), again.alias("repeated"), F.round(again / F.col("size"), 6).alias("density"))


@query("d01_barcodes")
def d01(t):
    return design.barcodes(t.spark, 5, 3, ["AAAA", "GGGG"])


@query("d04_spacers")
def d04(t):
    rows = dna(t).withColumn("need", 40 - F.length("s"))
    return design.spacers(rows, "p_partkey", F.col("need"), "s", ["GAATTC", "GGG", "AAA"])


@query("d05_split", f"WITH {PART} SELECT p_partkey, i::INT AS i, substr(s, (i * 8 + 1)::INT, 12) AS piece FROM (SELECT *, unnest(range(4)) AS i FROM d) WHERE i < ceil((32 - 4) / 8)")
def d05(t):
    return dna(t).select("p_partkey", F.inline(design.fragments(F.col("s"), 12, 4)))


@query("d06_pad", f"WITH {PART} SELECT p_partkey, 'AAAAAAA' || 'GGTCTC' || s || 'GAGACC' || 'AAAAAAAAA' AS padded FROM d".replace("'AAAAAAA'", "repeat('A', 8)").replace("'AAAAAAAAA'", "repeat('A', 8)"))
def d06(t):
    return dna(t).select("p_partkey", design.padded(F.col("s"), "GGTCTC", "GAGACC", 60).alias("padded"))


@query("d08_final", f"WITH {PART} SELECT p_partkey, s || 'GG' AS oligo, 34::BIGINT AS n FROM d")
def d08(t):
    rows = design.checked_table(dna(t), "p_partkey", ["s"])
    oligo = F.concat("s", F.lit("GG"))
    return rows.select("p_partkey", oligo.alias("oligo"), F.length(oligo).cast("long").alias("n"))


@query("e01_models", "SELECT p_partkey, unnest(['double_size', 'price']) AS model, unnest([2.0 * p_size, p_retailprice + 1]) AS prediction FROM part")
def e01(t):
    models = scoring.Models()
    models.add(lambda p_size, factor: factor * p_size, "double_size", factor=2.0)
    models.add(lambda p_retailprice: p_retailprice + 1, "price")
    return models.predict(t.part, "p_partkey")


QUERIES, ORACLE = group.queries, group.sql
