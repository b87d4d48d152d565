"""Vectors as integers, for the operators that compress and cluster them exactly."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No component is held beyond this.
LARGEST = 1 << 30


def sound(embedding: Column) -> Column:
    """Whether a vector isn't null and all its components are finite."""
    return embedding.isNotNull() & ~F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def kept(vectors: DataFrame, embedding: str, vec_id: str, *more: Column) -> DataFrame:
    """(vec_id long, ..., embedding array<double>) of the sound vectors, whatever other columns are called."""
    all_ = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), *more, F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    return all_.where(sound(F.col("embedding")))


def limit(width: int) -> int:
    """The largest component with which squared distances of vectors of a width stay below 2 ** 62."""
    return min(LARGEST, isqrt((1 << 62) // max(1, width)) // 2)


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), at most LARGEST away from 0."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * float(scale)), -LARGEST, LARGEST).astype(np.int32)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The components of a list column, one after the other, and the length of each list."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat, np.diff(column.offsets.to_numpy())


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each of c, as 64-bit integers."""
    most = max(1, int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # then doubles are exact
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    a, out = x.astype(np.int64), np.empty((len(x), len(c)), np.int64)
    for k, row in enumerate(c.astype(np.int64)):
        out[:, k] = ((a - row) ** 2).sum(1)
    return out


def first_rows(rows: DataFrame, order: Column, n: int) -> list:
    """The rows (vec_id, embedding) of the n first different vec_ids by order; of several rows of one the least vector. At most n rows."""
    ids = [r["vec_id"] for r in rows.where("vec_id IS NOT NULL").select("vec_id").distinct().orderBy(order, "vec_id").limit(n).collect()]
    found = {r["vec_id"]: r["embedding"] for r in rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).collect()} if ids else {}
    return [found[i] for i in ids]


def summed(rows: DataFrame, *key: str) -> list:
    """Rows (key, n, s) with the sums of counts n and of lists s by place. Sums are exact; one row for each key goes to the driver."""
    whole = rows.groupBy(*key).agg(F.sum("n").alias("n"))
    places = rows.select(*key, F.posexplode("s").alias("place", "v")).groupBy(*key, "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    lists_ = places.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("s"))
    return whole.join(lists_, list(key), "left").collect()


def as_long(c: Column) -> Column:
    """A sum as a long, at most the largest one."""
    return F.least(c.cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
