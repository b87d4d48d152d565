"""Queries over places, windows and runs; sorts, top rows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import rules
from ..operators import windows as N
from .base import Group

group = Group()
query = group.query
DNA = "translate(md5(CAST({} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
PART = f"SELECT p_partkey, {DNA.format('p_partkey')} AS s FROM part"


def dna(t):
    return t.part.select("p_partkey", S.derived_dna(F.col("p_partkey")).alias("s"))


_GC = "(20 - length(translate(substr(s, i, 20), 'GC', ''))) / 20.0"
_WINDOWS = f"WITH d AS ({PART}), w AS (SELECT p_partkey, s, i, (length(regexp_replace(substr(s, i, 20), '[^GC]', '', 'g')) / 20.0)::DOUBLE AS gc FROM (SELECT *, unnest(range(1, 13)) AS i FROM d))"


@query("n01_sliding_gc", _WINDOWS + " SELECT p_partkey, round(min(gc), 6) AS least, round(max(gc), 6) AS most, count(*) FILTER (WHERE gc < 0.3) AS low, count(*) FILTER (WHERE gc > 0.7) AS high FROM w GROUP BY 1")
def n01(t):
    gc = dna(t).withColumn("gc", S.window_shares(F.col("s"), 20))
    count = lambda f: F.size(F.filter("gc", f)).cast("long")
    return gc.select("p_partkey", F.round(F.array_min("gc"), 6).alias("least"), F.round(F.array_max("gc"), 6).alias("most"), count(lambda x: x < 0.3).alias("low"), count(lambda x: x > 0.7).alias("high"))


_H = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.NEAREST_ENTHALPY.items())
_S = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.NEAREST_ENTROPY.items())


@query(
    "n02_melting",
    f"WITH d AS ({PART}), p AS (SELECT p_partkey, length(s) AS n, sum(CASE substr(s, i, 2) {_H} END) AS h, sum(CASE substr(s, i, 2) {_S} END) AS e FROM (SELECT *, unnest(range(1, length(s))) AS i FROM d) GROUP BY 1, 2) SELECT p_partkey, round(h * 1000 / (e + 0.368 * ln(0.05) * (n - 1) + 1.987 * ln(5e-8 / 4)) - 273.15, 4) AS tm FROM p",
)
def n02(t):
    return dna(t).select("p_partkey", F.round(S.melting_temperature(F.col("s")), 4).alias("tm"))


@query("n03_window_range", _WINDOWS + ", r AS (SELECT p_partkey, max(gc) OVER k - min(gc) OVER k AS d, count(*) OVER k AS n FROM w WINDOW k AS (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT p_partkey, round(max(d), 6) AS most FROM r WHERE n = 5 GROUP BY 1")
def n03(t):
    gc = dna(t).withColumn("gc", S.window_shares(F.col("s"), 20))
    return gc.select("p_partkey", F.round(F.array_max(N.range_in_windows(F.col("gc"), 5)), 6).alias("most"))


@query("n04_terminal", f"WITH d AS ({PART}) SELECT p_partkey, round(length(regexp_replace(left(s, 10), '[^GC]', '', 'g')) / 10.0, 6)::DOUBLE AS first, round(length(regexp_replace(right(s, 10), '[^GC]', '', 'g')) / 10.0, 6)::DOUBLE AS last FROM d")
def n04(t):
    return dna(t).select("p_partkey", F.round(S.gc_content(F.left("s", F.lit(10))), 6).alias("first"), F.round(S.gc_content(F.right("s", F.lit(10))), 6).alias("last"))


@query(
    "n05_coverage",
    f"WITH d AS ({PART}), c AS (SELECT p_partkey, i, (substr(s, i, 2) IN ('AC', 'GT') OR substr(s, i - 1, 2) IN ('AC', 'GT'))::INT AS hit FROM (SELECT *, unnest(range(1, 33)) AS i FROM d)), w AS (SELECT p_partkey, avg(hit) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v, i FROM c) SELECT p_partkey, round(max(v), 6) AS densest FROM w WHERE i >= 10 GROUP BY 1",
)
def n05(t):
    at = lambda i: F.substring("s", i, F.lit(2)).isin("AC", "GT")
    hit = F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.when(at(i) | (F.when(i > 1, at(i - 1)).otherwise(F.lit(False))), 1.0).otherwise(0.0))
    rows = dna(t).withColumn("hit", hit)
    means = F.transform(F.sequence(F.lit(1), F.size("hit") - 9), lambda i: F.aggregate(F.slice("hit", i, F.lit(10)), F.lit(0.0), lambda a, x: a + x) / 10)
    return rows.select("p_partkey", F.round(F.array_max(means), 6).alias("densest"))


@query("n06_windowed_bound", _WINDOWS.replace("range(1, 13)", "range(1, 14)") + " SELECT p_partkey, bool_and(gc > 0.3 AND gc < 0.7) AS passes FROM w GROUP BY 1")
def n06(t):
    return dna(t).select("p_partkey", rules.composition_passes(F.col("s"), 20, 0.3, 0.7).alias("passes"))


_SCAN = """WITH c AS (SELECT l_returnflag, l_linestatus, l_linenumber, w.k, w.v, abs(l_quantity - w.v * l_linenumber) AS score FROM lineitem, (VALUES (1, 3.0), (2, 5.0), (3, 7.5)) w(k, v))
SELECT l_returnflag, l_linestatus, l_linenumber::BIGINT AS l_linenumber, round(min(score), 6)::DOUBLE AS score, arg_min(k, (score, k))::BIGINT AS k FROM c GROUP BY 1, 2, 3"""


@query("n09_argmin_config", _SCAN)
def n09(t):
    configs = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(v).alias("v")) for k, v in ((1, 3.0), (2, 5.0), (3, 7.5))]))
    rows = t.lineitem.select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity", configs.alias("w"))
    rows = rows.withColumn("score", F.abs(F.col("l_quantity") - F.col("w.v") * F.col("l_linenumber"))).withColumn("k", F.col("w.k"))
    return N.argmin(rows, ["l_returnflag", "l_linestatus", "l_linenumber"], "score", ["k"]).withColumn("score", F.round("score", 6))


@query("n10_running_lengths", "SELECT p_partkey, length(p_name)::BIGINT AS a, length(p_name || p_brand)::BIGINT AS b, length(p_name || p_brand || p_type)::BIGINT AS c FROM part")
def n10(t):
    n = [F.length(c).cast("long") for c in ("p_name", "p_brand", "p_type")]
    return t.part.select("p_partkey", n[0].alias("a"), (n[0] + n[1]).alias("b"), (n[0] + n[1] + n[2]).alias("c"))


@query(
    "n11_variable_regions",
    "WITH o AS (SELECT o_custkey, (epoch(o_orderdate) // 86400)::BIGINT AS d FROM orders GROUP BY ALL), g AS (SELECT *, CASE WHEN d - lag(d) OVER w > 60 OR lag(d) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY d)), r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY d) AS run FROM g) SELECT o_custkey, min(d) AS start, max(d) AS \"end\", count(*) AS n FROM r GROUP BY o_custkey, run HAVING count(*) > 1",
)
def n11(t):
    days = t.orders.select("o_custkey", F.floor(F.unix_timestamp("o_orderdate") / 86400).cast("long").alias("d")).distinct()
    return N.runs(days, ["o_custkey"], "d", 60).where("n > 1")


@query(
    "n12_quantile_normalise",
    "WITH l AS (SELECT p_partkey, 'p_size' AS c, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY v, p_partkey) AS r FROM l), m AS (SELECT r, avg(v) AS mean FROM r GROUP BY r) SELECT p_partkey, round(max(mean) FILTER (WHERE c = 'p_size'), 6) AS p_size, round(max(mean) FILTER (WHERE c = 'p_retailprice'), 6) AS p_retailprice FROM r JOIN m USING (r) GROUP BY 1",
)
def n12(t):
    out = N.rank_normalised(t.part, "p_partkey", ["p_size", "p_retailprice"])
    return out.select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


@query("t01_sort", "SELECT l_shipmode, n FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC")
def t01(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query("t02_topk_per_group", "SELECT o_orderpriority, o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 5")
def t02(t):
    out = N.top_k(t.orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    return out.select("o_orderpriority", "o_orderkey", "o_totalprice", F.col("place").cast("long").alias("place"))


@query("t03_nearest_k", "SELECT target, p_partkey, place FROM (SELECT t.target, p_partkey, row_number() OVER (PARTITION BY t.target ORDER BY abs(p_retailprice - t.target), p_partkey) AS place FROM part, (VALUES (950.0::DOUBLE), (1500.0), (1900.0)) t(target)) WHERE place <= 4")
def t03(t):
    rows = t.part.withColumn("target", F.explode(F.array(*map(F.lit, (950.0, 1500.0, 1900.0)))))
    out = N.top_k(rows, ["target"], [F.abs(F.col("p_retailprice") - F.col("target")), F.col("p_partkey")], 4)
    return out.select("target", "p_partkey", F.col("place").cast("long").alias("place"))


@query("t05_argmin", "SELECT l_partkey, min(l_extendedprice) AS l_extendedprice, arg_min(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) AS l_orderkey FROM lineitem GROUP BY 1")
def t05(t):
    return N.argmin(t.lineitem, ["l_partkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"]).drop("l_linenumber")


@query("t07_pareto_front", "SELECT p_partkey FROM (SELECT *, min(p_retailprice) OVER (ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS smaller, min(p_retailprice) OVER (PARTITION BY p_size) AS same FROM part) WHERE p_retailprice = same AND (smaller IS NULL OR smaller > p_retailprice)")
def t07(t):
    # Only the cheapest of a size can be on the front, so the sizes' least prices decide.
    sizes = t.part.groupBy("p_size").agg(F.min("p_retailprice").alias("least"))
    before = F.min("least").over(Window.orderBy("p_size").rowsBetween(Window.unboundedPreceding, -1))
    front = sizes.withColumn("smaller", before).where(F.col("smaller").isNull() | (F.col("smaller") > F.col("least")))
    return t.part.join(front.withColumnRenamed("least", "p_retailprice"), ["p_size", "p_retailprice"], "left_semi").select("p_partkey")


@query("t09_hash_split", "SELECT CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2))::INT < 64 THEN 'test' ELSE 'train' END AS fold, quality::BIGINT AS quality, count(*) AS n FROM labels GROUP BY 1, 2")
def t09(t):
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 2), 16, 10).cast("int")
    return t.labels.groupBy(F.when(h < 64, "test").otherwise("train").alias("fold"), F.col("quality").cast("long").alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query("u01_union_by_name", "SELECT kind, nation, count(*) AS n, round(sum(acctbal), 2) AS acctbal, count(segment) AS segments FROM (SELECT 'c' AS kind, c_nationkey AS nation, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT 's', s_nationkey, s_acctbal, NULL FROM supplier) GROUP BY 1, 2")
def u01(t):
    c = t.customer.select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("acctbal"))
    return c.unionByName(s, allowMissingColumns=True).groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("acctbal"), 2).alias("acctbal"), F.count("segment").alias("segments"))


@query("u04_min_index_distinct", "SELECT md5(text) AS h, min(doc_id) AS first FROM documents GROUP BY text")
def u04(t):
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("first")).select(F.md5(F.col("text").cast("binary")).alias("h"), "first")


@query("u06_setops", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def u06(t):
    c, s = t.customer.select("c_nationkey"), t.supplier.select("s_nationkey")
    count = lambda kind, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("both", c.intersect(s)).unionByName(count("only", c.subtract(s)))


QUERIES, ORACLE = group.queries, group.sql
