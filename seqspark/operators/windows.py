"""Computations over places within a string, and over runs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_places(df: DataFrame, text: str, motif: str) -> DataFrame:
    """Adds places: 0-based starts of a motif that can't overlap itself, from the lengths of the pieces between."""
    pieces = F.split(F.col(text), F.concat(F.lit("\\Q"), F.col(motif), F.lit("\\E")), -1)
    walk = F.aggregate(
        F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.length(p)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n + F.length(F.col(motif))).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")),
        lambda acc: acc["out"],
    )
    return df.withColumn("places", walk)


def runs(df: DataFrame, keys: list[str], place: str, gap: int = 1) -> DataFrame:
    """Gaps and islands: consecutive places at most gap apart form a region (keys, start, end, n)."""
    w = Window.partitionBy(*keys).orderBy(place)
    new = (F.coalesce(F.col(place) - F.lag(place).over(w) > gap, F.lit(True))).cast("int")
    marked = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_run").agg(F.min(place).alias("start"), F.max(place).alias("end"), F.count(F.lit(1)).alias("n")).drop("_run")


def range_in_windows(values: Column, width: int) -> Column:
    """Largest minus least value in each window of an array."""
    n = F.size(values) - width + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_max(F.slice(values, i, F.lit(width))) - F.array_min(F.slice(values, i, F.lit(width))))).otherwise(F.array().cast("array<double>"))


def rank_normalised(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Quantile normalisation: each value becomes the mean over columns of the values with its rank; ties by key.

    One row for each row and column is ranked within its column, and ranks meet in a group as small as the columns."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(key, "x.c", "x.v")
    ranked = long.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("v", key)))
    means = ranked.groupBy("r").agg(F.avg("v").alias("mean"))
    return ranked.join(means, "r").groupBy(key).pivot("c", columns).agg(F.first("mean"))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank of a value with ties at their mean."""
    rank, ties = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return F.rank().over(rank) + (F.count(F.lit(1)).over(ties) - 1) / 2


def argmin(df: DataFrame, by: list[str], score: str, keep: list[str]) -> DataFrame:
    """For each group the row with the least score; ties by the kept columns in order. Partial aggregates, no sort."""
    best = F.min(F.struct(score, *keep)).alias("_b")
    return df.groupBy(*by).agg(best).select(*by, *[F.col(f"_b.{c}").alias(c) for c in (score, *keep)])


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group; Spark cuts each partition to k rows of a group before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
