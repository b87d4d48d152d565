"""Queries of further constraints, parts and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constraints as C
from ..functions import sequences as S
from ..operators import filters as P
from ..operators import kmers, statistics
from .base import Group, kept, spread

group = Group()
query = group.query
DNA = "translate(md5(CAST({} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
PART = f"d AS (SELECT p_partkey, {DNA.format('p_partkey')} AS s FROM part)"
REV = "reverse(translate({0}, 'ACGT', 'TGCA'))"
CON = "translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTNRYN')"


def dna(t):
    return spread(t.part.select("p_partkey")).select("p_partkey", S.derived_dna(F.col("p_partkey")).alias("s"))


def constraints(t):
    return spread(t.customer.select("c_custkey")).select("c_custkey", F.translate(F.md5(F.col("c_custkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTNRYN").alias("s"))


@query("f27_sufficient_windows", f"WITH c AS (SELECT c_custkey, {CON} AS s FROM customer), w AS (SELECT c_custkey, i, substr(s, i + 1, 6) AS w FROM (SELECT *, unnest(range(27)) AS i FROM c)), b AS (SELECT c_custkey, i FROM w WHERE pow(4, length(w) - length(replace(w, 'N', ''))) * pow(2, length(w) - length(regexp_replace(w, '[RY]', '', 'g'))) < 4) SELECT c_custkey, count(*) AS n, min(i)::BIGINT AS first FROM b GROUP BY 1")
def f27(t):
    bad = constraints(t).select("c_custkey", P.sufficient_windows(F.col("s"), 6, 4.0).alias("bad"))
    return kept(bad, "c_custkey", F.struct(F.size("bad").cast("long").alias("n"), F.array_min("bad").cast("long").alias("first")), lambda x: x["n"] > 0)


@query("f32_blocked_prefixes", f"WITH m AS (SELECT DISTINCT substr({DNA.format('s_suppkey')}, 1, 5) AS m FROM supplier), p AS (SELECT substr(m, 1, i::INT) AS prefix, substr(m, i::INT + 1, 1) AS c FROM (SELECT m, unnest(range(1, 5)) AS i FROM m)) SELECT prefix FROM p GROUP BY 1 HAVING count(DISTINCT c) = 4")
def f32(t):
    m = t.supplier.select(F.substring(S.derived_dna(F.col("s_suppkey")), 1, 5).alias("m")).distinct()
    cut = m.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(4)))).select(F.expr("substring(m, 1, i)").alias("prefix"), F.expr("substring(m, i + 1)").alias("suffix"))
    return cut.groupBy("prefix").agg(F.collect_set(F.left("suffix", F.lit(1))).alias("next")).where(C.blocked(F.col("next"))).select("prefix")


@query("f33_design_space", "SELECT l::BIGINT AS length, pow(4, l)::BIGINT AS space, pow(4, l) >= (SELECT count(*) FROM part) AS enough FROM range(3, 9) r(l)")
def f33(t):
    n = t.part.agg(F.count(F.lit(1)).alias("n"))
    return t.spark.range(3, 9).crossJoin(F.broadcast(n)).select(F.col("id").alias("length"), F.pow(F.lit(4), "id").cast("long").alias("space"), (F.pow(F.lit(4), "id") >= F.col("n")).alias("enough"))


@query("f34_unused_composition", f"WITH {PART}, u AS (SELECT DISTINCT substr({DNA.format('s_suppkey + 7000')}, i, 6) AS k FROM (SELECT s_suppkey, unnest(range(1, 28)) AS i FROM supplier)) SELECT p_partkey FROM d WHERE p_partkey NOT IN (SELECT p_partkey FROM (SELECT p_partkey, substr(s, i, 6) AS k FROM (SELECT *, unnest(range(1, 28)) AS i FROM d)) JOIN u USING (k))")
def f34(t):
    used = kmers.background(kmers.exploded(t.supplier, "s_suppkey", S.derived_dna(F.col("s_suppkey") + 7000), 6))
    return kmers.clear_of(t.part, "p_partkey", kmers.exploded(dna(t), "p_partkey", F.col("s"), 6), used).select("p_partkey")


_H = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.NEAREST_ENTHALPY.items())
_S = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.NEAREST_ENTROPY.items())


@query("f36_melting_bounds", f"WITH {PART}, p AS (SELECT p_partkey, sum(CASE substr(s, i, 2) {_H} END) * 1000 / (sum(CASE substr(s, i, 2) {_S} END) + 0.368 * ln(0.05) * 31 + 1.987 * ln(5e-8 / 4)) - 273.15 AS tm FROM (SELECT *, unnest(range(1, 32)) AS i FROM d) GROUP BY 1) SELECT CASE WHEN tm < 64 THEN 'low' WHEN tm > 68 THEN 'high' ELSE 'ok' END AS verdict, count(*) AS n FROM p GROUP BY 1")
def f36(t):
    tm = S.melting_temperature(F.col("s"))
    return dna(t).groupBy(F.when(tm < 64, "low").when(tm > 68, "high").otherwise("ok").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("j09_contextual_membership", f"WITH {PART} SELECT a.p_partkey, count(*) AS n FROM (SELECT p_partkey, substr(s, i, 5) AS k FROM (SELECT *, unnest(range(1, 13)) AS i FROM d)) a JOIN (SELECT DISTINCT p_partkey, substr(s, i, 5) AS k FROM (SELECT *, unnest(range(17, 29)) AS i FROM d)) b USING (p_partkey, k) GROUP BY 1")
def j09(t):
    a, b = S.kmers(F.substring("s", 1, 16), 5), S.kmers(F.substring("s", 17, 16), 5)
    rows = dna(t).select("p_partkey", a.alias("a"), b.alias("b")).select("p_partkey", F.size(F.filter("a", lambda k: F.array_contains("b", k))).cast("long").alias("n"))
    return kept(rows, "p_partkey", F.struct("n"), lambda x: x["n"] > 0)


@query("j13_part_products", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey <> b.r_regionkey AND length(a.r_name) + length(b.r_name) <= 11")
def j13(t):
    # Libraries of parts are small by nature; the product is taken with one of them sent to all tasks.
    a, b = t.region.select(F.col("r_regionkey").alias("i"), F.col("r_name").alias("a")), t.region.select(F.col("r_regionkey").alias("j"), F.col("r_name").alias("b"))
    return a.join(F.broadcast(b), (F.col("i") != F.col("j")) & (F.length("a") + F.length("b") <= 11)).select("a", "b")


@query("j20_part_prefilter", f"WITH {PART}, u AS (SELECT {DNA.format('s_suppkey + 5000000')} AS s FROM supplier), b AS (SELECT DISTINCT substr(s, i, 9) AS k FROM (SELECT *, unnest(range(1, 25)) AS i FROM u)), h AS (SELECT DISTINCT p_partkey FROM (SELECT p_partkey, substr(s, i, 9) AS k FROM (SELECT *, unnest(range(1, 25)) AS i FROM d)) JOIN b USING (k)) SELECT p_partkey, s AS part FROM d WHERE p_partkey NOT IN (SELECT p_partkey FROM h)")
def j20(t):
    """The parts that hold no 9-mer of the suppliers' sequences."""
    known = kmers.exploded(t.supplier.select("s_suppkey", S.derived_dna(F.col("s_suppkey") + 5000000).alias("s")), "s_suppkey", F.col("s"), 9)
    parts = dna(t)
    return kmers.clear_of(parts, "p_partkey", kmers.exploded(parts, "p_partkey", F.col("s"), 9), kmers.background(known)).withColumnRenamed("s", "part")


@query("k12_fixed_places", f"SELECT c_custkey, count(*) AS n, max(i)::BIGINT AS last FROM (SELECT c_custkey, i, substr(s, i + 1, 1) AS c FROM (SELECT c_custkey, {CON} AS s, unnest(range(32)) AS i FROM customer)) WHERE c IN ('A', 'C', 'G', 'T') GROUP BY 1")
def k12(t):
    at = C.fixed_places(F.col("s"))
    return constraints(t).select("c_custkey", F.size(at).cast("long").alias("n"), F.array_max(at).cast("long").alias("last"))


@query("k13_remove_fix", "SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand%' THEN substr(p_brand, 6) ELSE p_brand END AS brand FROM part")
def k13(t):
    return t.part.select("p_partkey", C.without_fix(F.col("p_brand"), "Brand").alias("brand"))


@query("k14_longest_common", f"WITH c AS (SELECT p_partkey, {DNA.format('p_partkey')} AS a, {DNA.format('p_partkey + 1')} AS b FROM part), k AS (SELECT p_partkey, a, b, w, unnest(range(1, 34 - w)) AS i FROM (SELECT *, unnest(range(1, 9)) AS w FROM c)) SELECT p_partkey, max(w)::BIGINT AS n, max(w) <= 5 AS free FROM k WHERE contains(b, substr(a, i, w::INT)) GROUP BY 1")
def k14(t):
    # Both texts are columns first: within the expression each of its pieces would make them anew.
    both = dna(t).withColumn("b", S.derived_dna(F.col("p_partkey") + 1))
    return both.select("p_partkey", C.longest_common(F.col("s"), F.col("b"), 8).cast("long").alias("n")).withColumn("free", F.col("n") <= 5)


_DOT = "translate(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 12), '0123456789abcdef', '(((((......)))))')"


@query("k25_base_pairs", f"WITH RECURSIVE c AS (SELECT c_custkey, {_DOT} AS s FROM customer), e AS (SELECT c_custkey, i, substr(s, i, 1) AS c FROM (SELECT *, unnest(range(1, 13)) AS i FROM c)), w AS (SELECT c_custkey, 1 AS i, []::BIGINT[] AS o, 0::BIGINT AS n, 0::BIGINT AS total FROM c UNION ALL SELECT w.c_custkey, w.i + 1, CASE WHEN e.c = '(' THEN list_append(o, e.i) WHEN e.c = ')' AND len(o) > 0 THEN o[1:len(o) - 1] ELSE o END, n + (e.c = ')' AND len(o) > 0)::BIGINT, total + CASE WHEN e.c = ')' AND len(o) > 0 THEN e.i - o[len(o)] ELSE 0 END FROM w JOIN e ON e.c_custkey = w.c_custkey AND e.i = w.i) SELECT c_custkey, n AS pairs, total::BIGINT AS spans FROM w WHERE i = 13")
def k25(t):
    s = F.translate(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 12), "0123456789abcdef", "(((((......)))))")
    pairs = t.customer.select("c_custkey", C.base_pairs(s).alias("p"))
    return pairs.select("c_custkey", F.size("p").cast("long").alias("pairs"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["j"] - x["i"]).alias("spans"))


@query("k26_padded_matrix", "SELECT pos::BIGINT AS pos, count(*) FILTER (WHERE c = '-') AS gaps, count(DISTINCT c) AS symbols FROM (SELECT pos, substr(rpad(p_name, 30, '-'), pos::INT, 1) AS c FROM (SELECT p_name, unnest(range(1, 31)) AS pos FROM part)) GROUP BY 1")
def k26(t):
    chars = F.filter(F.split(F.rpad("p_name", 30, "-"), "", -1), lambda c: c != "")
    rows = t.part.select(F.posexplode(chars).alias("pos", "c"))
    return rows.groupBy((F.col("pos") + 1).cast("long").alias("pos")).agg(F.count(F.when(F.col("c") == "-", 1)).alias("gaps"), F.countDistinct("c").alias("symbols"))


@query("k27_mate_concat", f"SELECT p_partkey, {DNA.format('p_partkey')} || '-----' || {DNA.format('p_partkey + 1')} AS read FROM part")
def k27(t):
    return t.part.select("p_partkey", F.concat_ws("-----", S.derived_dna(F.col("p_partkey")), S.derived_dna(F.col("p_partkey") + 1)).alias("read"))


@query("k28_trim", f"WITH {PART} SELECT p_partkey, split_part(s, 'ACG', -1) AS rest FROM d WHERE contains(s, 'ACG')")
def k28(t):
    return dna(t).select("p_partkey", C.trimmed_after(F.col("s"), "ACG").alias("rest")).where("rest IS NOT NULL")


@query("k30_nearest_constant", "SELECT p_partkey, CASE WHEN length(p_type) >= 6 THEN right(p_type, 8) END AS prefix, CASE WHEN length(p_name) >= 6 THEN left(p_name, 8) END AS suffix FROM part")
def k30(t):
    return t.part.select("p_partkey", C.nearest(F.col("p_type"), 8).alias("prefix"), C.nearest(F.col("p_name"), 8, from_end=False).alias("suffix"))


@query("k32_normalised", f"SELECT p_partkey, replace(translate({DNA.format('p_partkey')}, 'ACGT', 'acgu'), 'u', 't') AS s FROM part")
def k32(t):
    rna = F.translate(S.derived_dna(F.col("p_partkey")), "ACGT", "acgu")
    return t.part.select("p_partkey", F.replace(rna, F.lit("u"), F.lit("t")).alias("s"))


@query("n07_windowed_melting", f"WITH {PART}, w AS (SELECT p_partkey, i, substr(s, i, 20) AS w FROM (SELECT *, unnest(range(1, 14)) AS i FROM d)), p AS (SELECT p_partkey, i, sum(CASE substr(w, j, 2) {_H} END) * 1000 / (sum(CASE substr(w, j, 2) {_S} END) + 0.368 * ln(0.05) * 19 + 1.987 * ln(5e-8 / 4)) - 273.15 AS tm FROM (SELECT *, unnest(range(1, 20)) AS j FROM w) GROUP BY 1, 2) SELECT p_partkey, round(min(tm), 4) AS least, round(max(tm), 4) AS most FROM p GROUP BY 1")
def n07(t):
    tm = F.transform(S.kmers(F.col("s"), 20), lambda w: S.melting_temperature(w))
    return dna(t).withColumn("tm", tm).select("p_partkey", F.round(F.array_min("tm"), 4).alias("least"), F.round(F.array_max("tm"), 4).alias("most"))


@query("d07_background", f"WITH k AS (SELECT DISTINCT least(substr(s, i, 6), {REV.format('substr(s, i, 6)')}) AS k FROM (SELECT *, unnest(range(1, 28)) AS i FROM (SELECT {DNA.format('p_partkey')} AS s FROM part))) SELECT count(*) AS kmers, count(*) < 0.99 * pow(4, 6) AS feasible FROM k")
def d07(t):
    known = kmers.background(kmers.exploded(dna(t), "p_partkey", F.col("s"), 6, "canonical"))
    return known.agg(F.count(F.lit(1)).alias("kmers"), (F.count(F.lit(1)) < 0.99 * 4**6).alias("feasible"))


@query("d11_guides", f"WITH {PART}, i AS (SELECT p_partkey, s, unnest(range(0, 21)) AS i FROM d) SELECT p_partkey, 'template' AS strand, i::BIGINT AS position, substr(s, i + 1, 9) AS guide FROM i WHERE substr(s, i + 11, 2) = 'GG' UNION ALL SELECT p_partkey, 'coding', i::BIGINT, {REV.format('substr(s, i + 4, 9)')} FROM i WHERE substr(s, i + 1, 2) = 'CC'")
def d11(t):
    at = dna(t).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20))))
    piece = lambda k, n: F.substring("s", F.col("i") + k, F.lit(n))
    template = at.where(piece(11, 2) == "GG").select("p_partkey", F.lit("template").alias("strand"), F.col("i").cast("long").alias("position"), piece(1, 9).alias("guide"))
    coding = at.where(piece(1, 2) == "CC").select("p_partkey", F.lit("coding").alias("strand"), F.col("i").cast("long").alias("position"), S.reverse_complement(piece(4, 9)).alias("guide"))
    return template.unionByName(coding)


@query("k35_start_codons", f"WITH {PART} SELECT p_partkey, count(*) AS n, min(i)::BIGINT AS first FROM (SELECT p_partkey, s, unnest(range(1, 31)) AS i FROM d) WHERE substr(s, i, 3) IN ('ATG', 'GTG', 'TTG') AND NOT list_bool_or([substr(s, (i + j * 3)::INT, 3) IN ('TAA', 'TAG', 'TGA') for j in range(1, 4)]) GROUP BY 1")
def k35(t):
    codon = lambda i: F.substring("s", i, F.lit(3))
    open_ = lambda i: ~F.exists(F.sequence(F.lit(1), F.lit(3)), lambda j: codon(i + j * 3).isin("TAA", "TAG", "TGA"))
    at = dna(t).withColumn("at", F.filter(F.sequence(F.lit(1), F.lit(30)), lambda i: codon(i).isin("ATG", "GTG", "TTG") & open_(i)))
    return at.where(F.size("at") > 0).select("p_partkey", F.size("at").cast("long").alias("n"), F.array_min("at").cast("long").alias("first"))


@query("t04_top_contributors", "WITH x AS (SELECT l_orderkey, l_linenumber, list_sort([{'v': -l_quantity / 50, 'f': 'quantity'}, {'v': -l_discount * 10, 'f': 'discount'}, {'v': -l_tax * 12, 'f': 'tax'}]) AS x FROM lineitem) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, x[i].f AS feature, i::BIGINT AS place FROM x, range(1, 3) r(i)")
def t04(t):
    named = F.array(*[F.struct((-v).alias("v"), F.lit(n).alias("feature")) for n, v in (("quantity", F.col("l_quantity") / 50), ("discount", F.col("l_discount") * 10), ("tax", F.col("l_tax") * 12))])
    best = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.posexplode(F.slice(F.array_sort(named), 1, 2)).alias("place", "x"))
    return best.select("l_orderkey", "l_linenumber", "x.feature", (F.col("place") + 1).cast("long").alias("place"))


@query("l10_sliding_folds", "SELECT fold::BIGINT AS fold, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) * 5 // (SELECT count(*) FROM labels) AS fold FROM labels) GROUP BY 1")
def l10(t):
    n = t.labels.count()
    folds = t.labels.withColumn("fold", F.floor((F.row_number().over(Window.orderBy("doc_id")) - 1) * 5 / n).cast("long"))
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("a24_simple_report", "WITH r AS (SELECT unnest([l_linestatus, 'ALL']) AS subgroup, l_extendedprice AS y, 1500 * l_quantity AS g FROM lineitem) SELECT subgroup, count(*) AS n, round(corr(y, g), 6) AS r, round(avg((greatest(g / y, y / g) <= 2)::INT::DOUBLE), 6) AS within_2, round(sqrt(avg((g - y) * (g - y))), 3) AS rmse FROM r GROUP BY 1")
def a24(t):
    y, g = F.col("l_extendedprice"), 1500 * F.col("l_quantity")
    rows = t.lineitem.select(F.explode(F.array("l_linestatus", F.lit("ALL"))).alias("subgroup"), y.alias("y"), g.alias("g"))
    near = (F.greatest(F.col("g") / F.col("y"), F.col("y") / F.col("g")) <= 2).cast("double")
    return rows.groupBy("subgroup").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("y", "g"), 6).alias("r"), F.round(F.avg(near), 6).alias("within_2"), F.round(F.sqrt(F.avg((F.col("g") - F.col("y")) * (F.col("g") - F.col("y")))), 3).alias("rmse"))


@query("a18_median_cutoff", "WITH m AS (SELECT median(n_chars) AS m FROM documents) SELECT count(*) FILTER (WHERE n_chars >= m) AS above, count(*) FILTER (WHERE n_chars < m) AS below FROM documents, m")
def a18m(t):
    m = t.documents.agg(F.median("n_chars").alias("m"))
    return t.documents.crossJoin(F.broadcast(m)).agg(F.count(F.when(F.col("n_chars") >= F.col("m"), 1)).alias("above"), F.count(F.when(F.col("n_chars") < F.col("m"), 1)).alias("below"))


@query("a05_barcode_groups", f"WITH b AS (SELECT substr({DNA.format('o_orderkey')}, 1, 7) AS b, o_orderkey FROM orders) SELECT b AS barcode, count(*) AS n, min(o_orderkey) AS first FROM b GROUP BY 1 HAVING count(*) > 1")
def a05(t):
    b = t.orders.groupBy(F.substring(S.derived_dna(F.col("o_orderkey")), 1, 7).alias("barcode")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
    return b.where("n > 1")


@query("a15_ftest_p")
def a15(t):
    f = statistics.variance_ratio(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice", True)
    return statistics.with_tails(f.select("l_returnflag", "f", (F.col("n_x") - 1).alias("d1"), (F.col("n_y") - 1).alias("d2")), "f", "d1", "d2")


QUERIES, ORACLE = group.queries, group.sql
