"""Mixing sources to target weights by systematic sampling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
#: Hexadecimal digits of the hash that part a step of size into buckets; no group that is ranked holds more than a small share of a source.
BUCKET_DIGITS = 3
OFFSET_SEED = 20240607


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources: (source, source_size), one row for each. Adds target.

    Sources in code-point order, null last, take the weights in turn. The share of a source is level * weight, at most most
    times its size. Resharing what is above until none is above ends at the level at which all targets add up to the total;
    sources reach their bound in the order of bound / weight, so running sums in that order give the level in one pass.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    ranked = ranked.withColumn("bound", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), "place")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = (
        ranked.withColumn("full", F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(whole))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    )
    # The first source whose bound isn't reached by the level that holds if all before it are full.
    first = F.min(F.when(F.col("bound") >= F.col("level") * F.col("weight"), F.struct(F.col("bound") / F.col("weight"), F.col("place"), F.col("level")))).over(whole)
    return ranked.withColumn("target", F.least("bound", F.coalesce(first.getField("level") * F.col("weight"), F.col("bound")))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = OFFSET_SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row for each row of docs.

    Every document of a source is expected target / source_size times. Documents stand in a fixed order (steps of size, then
    hash), the prefix sum of expected copies is taken along it, one offset between 0 and 1 is added, and a copy goes out
    for each integer that the document's stretch crosses. Order by size spreads long and short documents evenly, so the words
    taken come near the target. Ranks are taken in small buckets and shifted by the sizes of the buckets before, so no task
    holds a source. Null texts have size 0; null sources form one source; repeated rows count each; empty input gives no rows;
    copies of documents of size 0 take no words. Same rows, same seed: same result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    bits = F.length(F.bin(F.col("size") + 1))
    quarter = F.expr("shiftright((size + 1) * 4, length(bin(size + 1)) - 1)")  # 4 to 7: where size + 1 lies between two powers of 2
    spread = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    rows = rows.withColumn("step", (bits * 4 + quarter).cast("int")).withColumn("h", spread).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    rows = settle(rows, "mix")
    key = ["source", "step", "bucket"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    # The rows before a bucket: those of smaller steps of its source (a few hundred rows), and of smaller buckets of its step.
    ahead = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda n, window: F.coalesce(F.sum(n).over(window), F.lit(0))
    counts = settle(counts.withColumn("within", before("n", ahead("source", "step").orderBy("bucket"))), "mix")
    steps = counts.groupBy("source", "step").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    steps = settle(steps.withColumn("ahead", before("n", ahead("source").orderBy("step"))), "mix")
    targets = source_targets(steps.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    firsts = steps.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "step", "ahead", "source_size", "target")
    plan = counts.alias("c").join(firsts.alias("f"), F.col("c.source").eqNullSafe(F.col("f.source")) & (F.col("c.step") == F.col("f.step")))
    plan = plan.select("c.source", "c.step", "bucket", (F.col("within") + F.col("ahead")).alias("before"), "source_size", "target")
    local = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id", "size")))
    both = local.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.step") == F.col("p.step")) & (F.col("r.bucket") == F.col("p.bucket")))
    rate = F.when(F.col("p.source_size") > 0, F.col("p.target") / F.col("p.source_size")).otherwise(F.lit(0.0))
    place = F.col("p.before") + F.col("r.rank")
    mark = F.md5(F.concat(F.coalesce(F.col("r.source"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    offset = F.conv(F.substring(mark, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    crossed = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    return both.select("r.doc_id", "r.source", "r.size", "p.source_size", "p.target", F.least(F.lit(most), crossed).cast("long").alias("copies"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = rf"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
h AS (SELECT *, length(bin(size + 1)) * 4 + (((size + 1) * 4) >> (length(bin(size + 1)) - 1)) AS step, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{OFFSET_SEED}') AS h FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY step, h, doc_id, size) AS place FROM h),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
b AS (SELECT *, [{", ".join(f"{float(x)}::DOUBLE" for x in WEIGHTS)}][((k - 1) % {len(WEIGHTS)} + 1)::INT] AS weight, (source_size * {MOST})::DOUBLE AS bound FROM w),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(bound) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM b WINDOW o AS (ORDER BY bound / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (bound / weight, k)) AS level FROM l WHERE bound >= level * weight),
t AS (SELECT source, source_size, least(bound, coalesce(f.level * weight, bound)) AS target FROM l, f),
e AS (SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, ('0x' || substr(md5(coalesce(p.source, '') || ':{OFFSET_SEED}'), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least({MOST}, floor(place * rate + u) - floor((place - 1) * rate + u)) * size)::BIGINT AS taken FROM e"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLE = {"op7_mixing": ORACLE_SQL}
