"""Queries of aggregates and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import statistics as A
from .base import Group

group = Group()
query = group.query
DNA = "translate(md5(CAST({} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def rounded(df, *keep, digits=6):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


@query("a01_count_by_tuple", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def a01(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a02_distinct_count", "SELECT n, count(*) AS texts FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1) GROUP BY 1")
def a02(t):
    return t.documents.groupBy("text").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("texts"))


@query("a04_unique_count", "SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, count(*) AS n FROM part")
def a04(t):
    return t.part.agg(F.countDistinct("p_brand").alias("brands"), F.countDistinct("p_type").alias("types"), F.count(F.lit(1)).alias("n"))


@query("a05_duplicate_groups", "SELECT min(doc_id) AS first, count(*) AS n, max(doc_id) AS last FROM documents GROUP BY text HAVING count(*) > 1")
def a05(t):
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where("n > 1").drop("text")


@query("a06_length_stats", "SELECT min(length(p_name))::BIGINT AS least, max(length(p_name))::BIGINT AS most, max(length(p_name) + length(p_type))::BIGINT AS run, max(length(p_name) + length(p_type)) > 60 AS overflow FROM part")
def a06(t):
    n, both = F.length("p_name"), F.length("p_name") + F.length("p_type")
    return t.part.agg(F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.max(both).cast("long").alias("run"), (F.max(both) > 60).alias("overflow"))


@query("a07_approx_distinct")
def a07(t):
    return t.lineitem.agg(F.approx_count_distinct("l_partkey", 0.01).alias("parts"), F.approx_count_distinct("l_orderkey", 0.01).alias("orders"))


@query("a08_kmer_frequency", f"WITH k AS (SELECT substr(s, i, 5) AS kmer FROM (SELECT *, unnest(range(1, 29)) AS i FROM (SELECT {DNA.format('o_orderkey')} AS s FROM orders))) SELECT kmer, count(*) AS n FROM k GROUP BY 1")
def a08(t):
    return t.orders.select(F.explode(S.kmers(S.derived_dna(F.col("o_orderkey")), 5)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query("a09_partition_function", "SELECT l_returnflag, round(1 + sum(exp(-l_discount / 0.6)), 4) AS z, round(ln(1 + sum(exp(-l_discount / 0.6))), 6) AS lnz FROM lineitem GROUP BY 1")
def a09(t):
    z = 1 + F.sum(F.exp(-F.col("l_discount") / 0.6))
    return t.lineitem.groupBy("l_returnflag").agg(F.round(z, 4).alias("z"), F.round(F.ln(z), 6).alias("lnz"))


_ENT = "WITH c AS (SELECT {by} i::BIGINT AS pos, substr(s, i, 1) AS ch, count(*) AS n FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM ({src})) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY {by} pos) AS total FROM c) SELECT {by} pos, round(-sum(n / total * ln(n / total)) / ln({base}), 6) + 0.0 AS entropy FROM t GROUP BY ALL"


@query("a10_position_entropy", _ENT.format(by="p_brand,", src="SELECT p_brand, p_type AS s FROM part", base=2))
def a10(t):
    return rounded(A.position_entropy(t.part.select("p_brand", "p_type"), ["p_brand"], "p_type"), "p_brand", "pos")


@query("a11_base4_entropy", _ENT.format(by="", src=f"SELECT {DNA.format('p_partkey')} AS s FROM part", base=4))
def a11(t):
    return rounded(A.position_entropy(t.part.select(S.derived_dna(F.col("p_partkey")).alias("s")), [], "s", 4.0), "pos")


@query("a12_mad_outliers", "WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS mid FROM orders GROUP BY 1), d AS (SELECT o_orderpriority, mid, median(abs(o_totalprice - mid)) AS mad FROM orders JOIN m USING (o_orderpriority) GROUP BY 1, 2) SELECT o_orderpriority, round(min(mid), 4) AS mid, round(min(mad), 4) AS mad, count(*) FILTER (WHERE 0.6745 * abs(o_totalprice - mid) / mad > 2) AS outliers FROM orders JOIN d USING (o_orderpriority) GROUP BY 1")
def a12(t):
    out = A.mad_outliers(t.orders, ["o_orderpriority"], "o_totalprice")
    return out.groupBy("o_orderpriority").agg(F.round(F.min("mid"), 4).alias("mid"), F.round(F.min("mad"), 4).alias("mad"), F.count(F.when(F.col("outlier"), 1)).alias("outliers"))


@query("a13_ols", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1")
def a13(t):
    out = A.least_squares(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("a13_fixed_slope", "SELECT l_returnflag, 1000.0::DOUBLE AS slope, round(avg(l_extendedprice - 1000.0 * l_quantity), 4) AS intercept FROM lineitem GROUP BY 1")
def a13f(t):
    return A.least_squares(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice", 1000.0).withColumn("intercept", F.round("intercept", 4))


@query("a14_pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem GROUP BY 1")
def a14p(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"))


@query("a14_spearman", "WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS x, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS y FROM events WHERE value IS NOT NULL) SELECT event_type, round(corr(x, y), 6) AS spearman FROM r GROUP BY 1")
def a14s(t):
    return rounded(A.spearman(t.events.where("value IS NOT NULL"), ["event_type"], "value", "user_id"), "event_type")


@query("a14_kendall", "WITH n AS (SELECT l_returnflag AS g, l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT a.g, sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) / 2 AS s FROM n a JOIN n b USING (g) GROUP BY 1), x AS (SELECT g, sum(t * (t - 1) / 2) AS tx, sum(t) AS n FROM (SELECT g, x, sum(n) AS t FROM n GROUP BY 1, 2) GROUP BY 1), y AS (SELECT g, sum(t * (t - 1) / 2) AS ty FROM (SELECT g, y, sum(n) AS t FROM n GROUP BY 1, 2) GROUP BY 1) SELECT g AS l_returnflag, round(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6)::DOUBLE AS kendall FROM s JOIN x USING (g) JOIN y USING (g)")
def a14k(t):
    return rounded(A.kendall(t.lineitem, ["l_returnflag"], "l_quantity", "l_discount"), "l_returnflag")


@query("a15_ftest_stat", "SELECT l_returnflag, round(exp(var_pop(ln(l_quantity))) / exp(var_pop(ln(l_extendedprice))), 6) AS f, count(l_quantity) AS n_x, count(l_extendedprice) AS n_y FROM lineitem GROUP BY 1")
def a15(t):
    return A.variance_ratio(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice", True).withColumn("f", F.round("f", 6))


@query("a16_welch_stat", "WITH s AS (SELECT l_linestatus, avg(l_quantity) FILTER (WHERE l_discount > 0.05) AS m1, var_samp(l_quantity) FILTER (WHERE l_discount > 0.05) / count(*) FILTER (WHERE l_discount > 0.05) AS a, count(*) FILTER (WHERE l_discount > 0.05) AS n1, avg(l_quantity) FILTER (WHERE NOT l_discount > 0.05) AS m0, var_samp(l_quantity) FILTER (WHERE NOT l_discount > 0.05) / count(*) FILTER (WHERE NOT l_discount > 0.05) AS b, count(*) FILTER (WHERE NOT l_discount > 0.05) AS n0 FROM lineitem GROUP BY 1) SELECT l_linestatus, round((m1 - m0) / sqrt(a + b), 6) AS t, round((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)), 4) AS df FROM s")
def a16(t):
    out = A.welch(t.lineitem, ["l_linestatus"], F.col("l_discount") > 0.05, "l_quantity")
    return out.select("l_linestatus", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query("a16_welch_p")
def a16p(t):
    return A.with_tails(A.welch(t.lineitem, ["l_linestatus"], F.col("l_discount") > 0.05, "l_quantity"), "t", "df")


@query("a17_ecdf", "SELECT e::DOUBLE AS edge, round((SELECT avg((n_chars <= e)::INT::DOUBLE) FROM documents), 6) AS share FROM (VALUES (100.0), (500.0), (1000.0), (5000.0), (20000.0)) t(e)")
def a17(t):
    return A.empirical_cdf(t.documents, "n_chars", [100.0, 500.0, 1000.0, 5000.0, 20000.0]).withColumn("share", F.round("share", 6))


@query("a18_roc_auc", "WITH d AS (SELECT n_chars::DOUBLE AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)), e AS (SELECT 0.9 * min(s) AS a, 1.1 * max(s) AS b FROM d), c AS (SELECT i, a + (b - a) * i / 49 AS cut FROM e, range(50) r(i)), p AS (SELECT i, count(*) FILTER (WHERE s >= cut AND NOT y) / count(*) FILTER (WHERE NOT y) AS f, count(*) FILTER (WHERE s >= cut AND y) / count(*) FILTER (WHERE y) AS t FROM c, d GROUP BY i), q AS (SELECT f, arg_min(t, i) AS t FROM p GROUP BY f), z AS (SELECT * FROM q UNION ALL SELECT 0, 0 WHERE NOT EXISTS (FROM q WHERE f = 0) UNION ALL SELECT 1, 1 WHERE NOT EXISTS (FROM q WHERE f = 1)) SELECT round(sum((f - pf) * (t + pt) / 2), 6) AS auc, (count(*))::BIGINT AS n_points FROM (SELECT *, lag(f) OVER (ORDER BY f) AS pf, lag(t) OVER (ORDER BY f) AS pt FROM z)")
def a18(t):
    rows = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("s")).join(t.labels, "doc_id")
    return A.roc(rows, "s", F.col("quality") == 1).withColumn("auc", F.round("auc", 6))


@query("a19_pdf", "WITH b AS (SELECT CASE WHEN v >= 0 AND v < 100 THEN floor(v / 5)::BIGINT WHEN v = 100 THEN 19 END AS bin FROM (SELECT value AS v FROM events)), c AS (SELECT bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY 1) SELECT r.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM c), 6) AS share FROM range(20) r(bin) LEFT JOIN c USING (bin)")
def a19(t):
    return A.histogram(t.events, F.col("value"), 0.0, 100.0, 20).withColumn("share", F.round("share", 6))


@query("a20_kl", "WITH c AS (SELECT l_linenumber, count(*) FILTER (WHERE l_returnflag = 'A') AS p, count(*) FILTER (WHERE l_returnflag <> 'A') AS q FROM lineitem GROUP BY 1) SELECT round(sum(p / tp * ln((p / tp) / (q / tq))), 6) AS kl FROM (SELECT *, sum(p) OVER () AS tp, sum(q) OVER () AS tq FROM c) WHERE p > 0")
def a20(t):
    flag = F.col("l_returnflag") == "A"
    counts = t.lineitem.groupBy("l_linenumber").agg(F.sum(flag.cast("double")).alias("p"), F.sum((~flag).cast("double")).alias("q"))
    return counts.agg(F.round(A.divergence(F.col("p"), F.col("q")), 6).alias("kl"))


@query("a21_norm_kl", "WITH b AS (SELECT floor(v / 5)::BIGINT AS bin, count(*) AS n FROM (SELECT value AS v FROM events) WHERE v >= 0 AND v < 100 GROUP BY 1) SELECT round(sum(n / t * ln(n / t * 20)) / ln(20), 6) AS nkl FROM (SELECT *, sum(n) OVER () AS t FROM b)")
def a21(t):
    inside = t.events.where("value >= 0 AND value < 100")
    h = A.histogram(inside, F.col("value"), 0.0, 100.0, 20)
    return h.agg(F.round(A.divergence(F.col("n").cast("double"), F.lit(1.0)) / F.ln(F.lit(20.0)), 6).alias("nkl"))


@query("a22_model_capacity", _ENT.format(by="", src=f"SELECT {DNA.format('p_partkey')} AS s FROM part", base=2).replace("SELECT  pos, round(-sum(n / total * ln(n / total)) / ln(2), 6) + 0.0 AS entropy FROM t GROUP BY ALL", "SELECT round(sum(e) * (SELECT count(*) - 1 FROM part) * 0.25, 3) AS bits FROM (SELECT pos, -sum(n / total * ln(n / total)) / ln(2) AS e FROM t GROUP BY pos)"))
def a22(t):
    h = A.position_entropy(t.part.select(S.derived_dna(F.col("p_partkey")).alias("s")), [], "s").agg(F.sum("entropy").alias("h"))
    n = t.part.agg(F.count(F.lit(1)).alias("n"))
    return h.crossJoin(n).select(F.round(F.col("h") * (F.col("n") - 1) * 0.25, 3).alias("bits"))


@query("a23_subgroup_report", "WITH r AS (SELECT unnest([l_returnflag, 'ALL']) AS subgroup, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT subgroup, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM r GROUP BY 1), s AS (SELECT r.*, slope * x + intercept AS g FROM r JOIN f USING (subgroup)), m AS (SELECT subgroup, sqrt(avg((g - y) * (g - y))) AS rmse, avg((g > 0 AND y > 0 AND greatest(g / y, y / g) <= 2)::INT::DOUBLE) AS within_2, avg((g > 0 AND y > 0 AND greatest(g / y, y / g) <= 5)::INT::DOUBLE) AS within_5, avg((g > 0 AND y > 0 AND greatest(g / y, y / g) <= 10)::INT::DOUBLE) AS within_10 FROM s GROUP BY 1) SELECT subgroup, n, round(slope, 3) AS slope, round(intercept, 3) AS intercept, round(r2, 6) AS r2, round(rmse, 3) AS rmse, round(within_2, 4) AS within_2, round(within_5, 4) AS within_5, round(within_10, 4) AS within_10 FROM f JOIN m USING (subgroup)")
def a23(t):
    r = A.subgroup_report(t.lineitem, "l_returnflag", "l_quantity", "l_extendedprice")
    places = {"slope": 3, "intercept": 3, "r2": 6, "rmse": 3, "within_2": 4, "within_5": 4, "within_10": 4}
    return r.select("subgroup", "n", *[F.round(c, d).alias(c) for c, d in places.items()])


@query("a25_rollup", "SELECT coalesce(l_returnflag, 'ALL') AS subgroup, count(*) AS n, round(avg(l_quantity), 6) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())")
def a25(t):
    out = t.lineitem.rollup("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("quantity"))
    return out.select(F.coalesce("l_returnflag", F.lit("ALL")).alias("subgroup"), "n", "quantity")


@query("a26_compare_models", "WITH e AS (SELECT l_returnflag, abs(l_extendedprice - 1000 * l_quantity) AS a, abs(l_extendedprice - 1500 * l_quantity) AS b FROM lineitem) SELECT l_returnflag, round(var_pop(a) / var_pop(b), 6) AS f, round((avg(a) - avg(b)) / sqrt(var_samp(a) / count(*) + var_samp(b) / count(*)), 5) AS t FROM e GROUP BY 1")
def a26(t):
    rows = t.lineitem.select("l_returnflag", F.abs(F.col("l_extendedprice") - 1000 * F.col("l_quantity")).alias("a"), F.abs(F.col("l_extendedprice") - 1500 * F.col("l_quantity")).alias("b"))
    f = A.variance_ratio(rows, ["l_returnflag"], "a", "b").select("l_returnflag", F.round("f", 6).alias("f"))
    long = rows.select("l_returnflag", F.inline(F.array(F.struct(F.lit(True).alias("one"), F.col("a").alias("v")), F.struct(F.lit(False).alias("one"), F.col("b").alias("v")))))
    return f.join(A.welch(long, ["l_returnflag"], F.col("one"), "v").select("l_returnflag", F.round("t", 5).alias("t")), "l_returnflag")


@query("a27_replicate_ratio", "SELECT l_returnflag, round(avg(exp((1 * ln(1 + l_quantity) + 2 * ln(1 + l_discount) + 3 * ln(1 + l_tax)) / 6)), 6) AS mean, round(var_samp(exp((1 * ln(1 + l_quantity) + 2 * ln(1 + l_discount) + 3 * ln(1 + l_tax)) / 6)), 6) AS var FROM lineitem GROUP BY 1")
def a27(t):
    weights = {"l_quantity": 1.0, "l_discount": 2.0, "l_tax": 3.0}
    g = F.exp(A.summed([F.lit(w) * F.ln(1 + F.col(c)) for c, w in weights.items()]) / sum(weights.values()))
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg(g), 6).alias("mean"), F.round(F.var_samp(g), 6).alias("var"))


@query("a28_ratio_variance", "SELECT l_returnflag, round(m1 * m1 / (m2 * m2) * (v1 / (m1 * m1) + v2 / (m2 * m2)), 9) AS v FROM (SELECT l_returnflag, avg(l_quantity) AS m1, var_samp(l_quantity) AS v1, avg(l_extendedprice) AS m2, var_samp(l_extendedprice) AS v2 FROM lineitem GROUP BY 1)")
def a28(t):
    s = t.lineitem.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m1"), F.var_samp("l_quantity").alias("v1"), F.avg("l_extendedprice").alias("m2"), F.var_samp("l_extendedprice").alias("v2"))
    return s.select("l_returnflag", F.round(F.expr("m1 * m1 / (m2 * m2) * (v1 / (m1 * m1) + v2 / (m2 * m2))"), 9).alias("v"))


@query("a29_describe", "SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS least, max(n_chars) AS most FROM documents")
def a29(t):
    return t.documents.agg(F.count("n_chars").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_samp("n_chars"), 6).alias("std"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("a30_r2_without_null", "WITH p AS (SELECT l_returnflag, l_extendedprice AS y, 1500 * l_quantity AS g FROM lineitem WHERE l_extendedprice IS NOT NULL), m AS (SELECT *, avg(y) OVER (PARTITION BY l_returnflag) AS m FROM p) SELECT l_returnflag, round(1 - sum((y - g) * (y - g)) / sum((y - m) * (y - m)), 6) AS r2 FROM m GROUP BY 1")
def a30(t):
    y, g = F.col("l_extendedprice"), 1500 * F.col("l_quantity")
    return t.lineitem.where(y.isNotNull() & g.isNotNull()).groupBy("l_returnflag").agg(F.round(1 - F.sum((y - g) * (y - g)) / (F.var_pop(y) * F.count(y)), 6).alias("r2"))


@query("a31_rsquared", "SELECT l_linestatus, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def a31(t):
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


@query("a32_fmk", "WITH k AS (SELECT count(*) FILTER (WHERE y AND g)::DOUBLE AS tp, count(*) FILTER (WHERE NOT y AND g)::DOUBLE AS fp, count(*) FILTER (WHERE y AND NOT g)::DOUBLE AS fn, count(*) FILTER (WHERE NOT y AND NOT g)::DOUBLE AS tn FROM (SELECT quality = 1 AS y, n_chars > 700 AS g FROM documents JOIN labels USING (doc_id))), s AS (SELECT 2 * tp / (2 * tp + fp + fn) AS f1, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc, ((tp + tn) / (tp + fp + fn + tn) - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn))) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn))) AS kappa FROM k) SELECT round(f1, 6) AS f1, round(mcc, 6) AS mcc, round(kappa, 6) AS kappa, round(sign(f1 * mcc * kappa) * pow(abs(f1 * mcc * kappa), 1 / 3.0), 6) AS fmk FROM s")
def a32(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return rounded(A.confusion_scores(rows, F.col("quality") == 1, F.col("n_chars") > 700))


@query("a36_importance_summary", "SELECT feature, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM (SELECT 'quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY 1")
def a36(t):
    long = t.lineitem.select(F.inline(F.array(F.struct(F.lit("quantity").alias("feature"), F.col("l_quantity").alias("v")), F.struct(F.lit("tax").alias("feature"), F.col("l_tax").alias("v")))))
    return long.groupBy("feature").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"))


@query("a37_f_regression", "SELECT round(c * c / (1 - c * c) * (n - 2), 4) AS f FROM (SELECT corr(l_quantity, l_extendedprice) AS c, count(*) AS n FROM lineitem)")
def a37(t):
    s = t.lineitem.agg(F.corr("l_quantity", "l_extendedprice").alias("c"), F.count(F.lit(1)).alias("n"))
    return s.select(F.round(F.expr("c * c / (1 - c * c) * (n - 2)"), 4).alias("f"))


@query("a38_by_length", "SELECT length(p_name)::BIGINT AS n, count(DISTINCT p_name) AS names, min(p_name) AS first FROM part GROUP BY 1")
def a38(t):
    return t.part.groupBy(F.length("p_name").cast("long").alias("n")).agg(F.countDistinct("p_name").alias("names"), F.min("p_name").alias("first"))


QUERIES, ORACLE = group.queries, group.sql
