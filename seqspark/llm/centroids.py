"""Clustering of vectors around centroids, with lower bounds from segment norms."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .integers import first_rows, floors, kept, limit, lists, summed

WIDTH, CENTROIDS, ROUNDS, SCALE, SEGMENTS = 64, 16, 3, 64, 8


def segment_norms(x: np.ndarray, segments: int) -> np.ndarray:
    """The norm of each of the consecutive segments of each row: the compressed form of a vector."""
    starts = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)[:-1])
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, starts, axis=1))


def lower_bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the squared distances of vectors with the segment norms a to centroids with b are at least. By Cauchy and Schwarz a
    segment's product is at most that of the norms, so the distance is at least that of the vectors of norms. A little less, for rounding."""
    aa, bb = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    return aa + bb - 2.0 * (a @ b.T) - 1e-9 * (aa + bb)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of each row's nearest centroid (ties: the smaller), the exact squared distance, and how many distances were taken.

    Centroids are tried in the order of their lower bounds, as long as the bound doesn't exceed the least distance so far."""
    x = x.astype(np.int64)
    bounds = lower_bounds(norms, segment_norms(centroids, segments))
    order = np.argsort(bounds, axis=1, kind="stable")
    cluster, best, taken = np.full(len(x), len(centroids), np.int32), np.full(len(x), np.iinfo(np.int64).max), 0
    left = np.arange(len(x))
    for j in range(len(centroids)):
        left = left[bounds[left, order[left, j]] <= best[left]]
        if not len(left):
            break
        c = order[left, j]
        d = ((x[left] - centroids[c]) ** 2).sum(1)
        closer = (d < best[left]) | ((d == best[left]) & (c < cluster[left]))
        cluster[left[closer]], best[left[closer]] = c[closer], d[closer]
        taken += len(left)
    return cluster, best, taken


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The integers and segment norms of a batch."""
    x, norms = (batch.column(n).flatten().to_numpy() for n in ("m", "norms"))
    return x.reshape(-1, width), norms.reshape(batch.num_rows, -1)


def cluster_vectors(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", width: int = WIDTH, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, segments: int = SEGMENTS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each vector that is kept.

    Kept are vectors of width components, none null or non-finite; a component x counts as floor(scale * x), held within
    limit(width) of 0 (134,217,728 for width 64) so that distances fit in a long. The first centroids are the k different vec_ids with the least sha256 of
    1:<vec_id> (of several vectors of one the least); fewer if there are fewer. Each round assigns all vectors to the nearest centroid, ties to the
    smaller number, and moves each non-empty centroid to the floor of its vectors' mean; then they are assigned once more.
    Integers and segment norms are worked out once and written; a round reads them and gives sums of each task, k rows, which
    are folded before the driver has k rows of them. Repeated rows count as often as they stand there; vectors without vec_id are assigned but
    no first centroids; where no vec_id is, or no vector is kept, there are no rows; other columns don't matter.
    """
    spark, most = vectors.sparkSession, limit(width)
    rows = kept(vectors, embedding, vec_id).where(F.size("embedding") == width)

    def shrink(batches):
        for batch in batches:
            x = np.clip(floors(lists(batch.column("embedding"))[0], scale), -most, most).reshape(-1, width)
            norms = segment_norms(x, segments)
            each = lambda m: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), each(x), each(norms)], names=["vec_id", "m", "norms"])

    small = settle(rows.mapInArrow(shrink, "vec_id long, m array<int>, norms array<double>"), "centroids")
    start = first_rows(small.select("vec_id", F.col("m").alias("embedding")), F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256), k)
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array(start, np.int64)

    for _ in range(rounds):

        def fold(batches, c=centroids):
            n, s = np.zeros(len(c), np.int64), np.zeros((len(c), width), np.int64)
            for batch in batches:
                x, norms = _read(batch, width)
                at = nearest(x, norms, c, segments)[0]
                n += np.bincount(at, minlength=len(c))
                for e in np.unique(at):
                    s[e] += x[at == e].sum(0, dtype=np.int64)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": n[some], "s": pa.array(list(s[some]), pa.list_(pa.int64()))})

        for r in summed(small.mapInArrow(fold, "cluster int, n long, s array<long>"), "cluster"):  # k rows at most
            centroids[r["cluster"]] = [int(v) // r["n"] for v in r["s"]]

    def assign(batches):
        for batch in batches:
            at, best, _ = nearest(*_read(batch, width), centroids, segments)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at), pa.array(best)], names=["vec_id", "cluster", "distance"])

    out = settle(small.mapInArrow(assign, "vec_id long, cluster int, distance long"), "centroids")
    sums = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows at most
    top, total = (1 << 63) - 1, sum(map(int, sums.values()))
    told = [(e, min(top, int(d)), min(top, total), sha256(",".join(map(str, centroids[e].tolist())).encode()).hexdigest()) for e, d in sums.items()]
    return out.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


_ASSIGN = """d{r} AS MATERIALIZED (SELECT v.vec_id, v.m, c.k, list_inner_product(v.m, v.m) + list_inner_product(c.c, c.c) - 2 * list_inner_product(v.m, c.c) AS d FROM v, c{r} c),
a{r} AS MATERIALIZED (SELECT vec_id, m, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1),"""
_MOVE = """s{n} AS (SELECT k, p, floor(sum(m[p])::DOUBLE / count(*)) AS x FROM a{r}, range(1, 65) AS t(p) GROUP BY k, p),
c{n} AS MATERIALIZED (SELECT c.k, coalesce(x.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT k, list(x ORDER BY p) AS c FROM s{n} GROUP BY k) x USING (k)),"""
ORACLE_SQL = (
    """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS m FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS k, m AS c FROM v WHERE vec_id IS NOT NULL QUALIFY k < 16),
"""
    + "".join(_ASSIGN.format(r=r) + "\n" + (_MOVE.format(r=r, n=r + 1) + "\n" if r < 3 else "") for r in range(4))
    + """i AS (SELECT k, sum(d)::BIGINT AS cluster_inertia FROM a3 GROUP BY k)
SELECT vec_id, k AS cluster, d::BIGINT AS distance, cluster_inertia, (SELECT sum(d) FROM a3)::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a3 JOIN i USING (k) JOIN c3 USING (k)"""
)

QUERIES = {"op12_centroids": op12_centroids}
ORACLE = {"op12_centroids": ORACLE_SQL}
