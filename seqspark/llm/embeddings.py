"""Exact near-duplicate pairs of embeddings by dual traversal of cover trees."""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, settle, table

LEAST_COSINE = 0.98
#: Rows of a tree, and the most pivots of all labels together (a sample of the rows by hash; only speed depends on it).
TREE_ROWS, MOST_PIVOTS = 1024, 4096
SLACK = 1e-9


class CoverTree:
    """Nested levels over unit vectors: the centres of a level lie more than its radius apart and cover all vectors within it,
    each level's radius is half of the one above, and the centres of a level stay centres below. The last level holds every vector."""

    def __init__(self, x: np.ndarray, radius: float = 1.0, least: float = 0.12):
        self.x, self.levels = x, []
        nearest, centres = np.zeros(len(x), np.int64), np.array([0])
        gap = np.linalg.norm(x - x[0], axis=1)
        self._add(centres, nearest, gap)
        while radius >= least:
            for i in range(len(x)):
                if gap[i] > radius:
                    d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ x[i])))
                    closer = d < gap
                    gap = np.where(closer, d, gap)
                    nearest = np.where(closer, len(centres), nearest)
                    centres = np.append(centres, i)
            self._add(centres, nearest, gap)
            radius /= 2
        self._add(np.arange(len(x)), np.arange(len(x)), np.zeros(len(x)))

    def _add(self, centres: np.ndarray, nearest: np.ndarray, gap: np.ndarray) -> None:
        """A level: its centres, the node of each vector, for each node the covering radius of its own vectors and its parent.

        Children hang below the node whose vectors they are of, so a node's radius bounds all that is below it: the vectors of a
        child are found by the parent's node of the child's centre, and the radius is taken over them."""
        if self.levels:
            parent = self.levels[-1]["node"][centres]
            node = nearest
            if not np.array_equal(self.levels[-1]["node"], parent[node]):  # a vector that would leave its parent's node
                node = np.where(self.levels[-1]["node"] == parent[node], node, -1)
                for i in np.flatnonzero(node < 0):
                    own = np.flatnonzero(parent == self.levels[-1]["node"][i])
                    d = np.linalg.norm(self.x[centres[own]] - self.x[i], axis=1)
                    node[i] = own[np.argmin(d)]
                gap = np.linalg.norm(self.x - self.x[centres[node]], axis=1)
        else:
            parent, node = np.zeros(len(centres), np.int64), nearest
        radius = np.zeros(len(centres))
        np.maximum.at(radius, node, gap)
        self.levels.append({"centre": centres, "node": node, "radius": radius, "parent": parent})


def dual(a: CoverTree, b: CoverTree, reach: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of vectors of two trees that may lie within reach: both trees are walked down level by level, and a pair of nodes is
    left out with all below it when the distance of their centres exceeds both covering radii and reach. The pairs of a
    level are those of the level above taken apart into children, held as a mask."""
    alive = np.ones((1, 1), bool)
    depth = max(len(a.levels), len(b.levels))
    for k in range(depth):
        la, lb = a.levels[min(k, len(a.levels) - 1)], b.levels[min(k, len(b.levels) - 1)]
        pa_, pb = (la["parent"] if k < len(a.levels) else np.arange(len(la["centre"]))), (lb["parent"] if k < len(b.levels) else np.arange(len(lb["centre"])))
        alive = alive[np.ix_(pa_, pb)]
        i, j = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(i):
            break
        gram = a.x[la["centre"][i]] @ b.x[lb["centre"][j]].T
        far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * gram)) > la["radius"][i][:, None] + lb["radius"][j][None, :] + reach + SLACK
        alive[np.ix_(i, j)] &= ~far
    x, y = np.nonzero(alive)
    if same:
        keep = x < y
        x, y = x[keep], y[keep]
    return x, y


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that squares neither overflow nor vanish; directions stay."""
    return m / np.abs(m).max(1, keepdims=True)


def unit(m: np.ndarray) -> np.ndarray:
    m = scaled(m)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of scaled rows in double precision."""
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


KEY = ("label", "width", "cell_a", "part_a", "cell_b", "part_b")


def _blocks(rows: DataFrame, least: float) -> DataFrame:
    """(vec, n, other) for the blocks of rows (KEY, half, vec, embedding): the number of links that vec has in the block, and the
    smallest vec that it is connected to in it."""
    reach = sqrt(max(0.0, 2.0 - 2.0 * least))

    def run(block: pa.Table) -> pa.Table:
        half = block.column("half").to_numpy()
        at = [block.column(k)[0].as_py() for k in KEY]
        same = at[2:4] == at[4:6]
        ids = block.column("vec").to_numpy()
        m = scaled(matrix(block.column("embedding"), at[1]))
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        first, second = np.flatnonzero(half == 0), np.flatnonzero(half == 1)
        i, j = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(first) and (same or len(second)):
            tree = CoverTree(unit(m[first]))
            to = first if same else second
            i, j = dual(tree, tree if same else CoverTree(unit(m[second])), reach, same)
            x, y = m[first], m[to]
            hit = np.concatenate([cosines(x[i[k : k + 65536]], y[j[k : k + 65536]]) >= least for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
            i, j = first[i[hit]], to[j[hit]]
        links += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        while len(i):  # labels sink to the least of each connected part
            before = label.copy()
            np.minimum.at(label, i, label[j])
            np.minimum.at(label, j, label[i])
            label = label[label]
            if np.array_equal(before, label):
                break
        some = np.flatnonzero(links)
        return pa.table({"vec": ids[some], "n": links[some], "other": ids[label[some]]})

    return rows.groupBy(*KEY).applyInArrow(run, "vec long, n long, other long")


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column of one width, in double precision."""
    flat = pa.chunked_array(column).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def by_kind(batch: pa.RecordBatch) -> list[tuple]:
    """(label, width, places) of the rows of a batch."""
    kinds: dict[tuple, list[int]] = {}
    for i, k in enumerate(zip(batch.column("label").to_pylist(), batch.column("width").to_pylist(), strict=True)):
        kinds.setdefault(k, []).append(i)
    return [(lab, width, np.array(at)) for (lab, width), at in kinds.items()]


def near_vectors(vectors: DataFrame, embedding: str = "embedding", label: str = "label", vec_id: str = "vec_id", least: float = LEAST_COSINE, tree_rows: int = TREE_ROWS, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors.

    Vectors with the same label link when their cosine, in double precision, is at least least. The vectors of a label go to
    the nearest of its pivots, a cell to one block or several of about tree_rows rows, and each pair of blocks that can hold
    links becomes a task: pairs of cells are left out by their covering radii, rows by their distance to the other
    cell's pivot and to the plane halfway between both pivots. In a task the trees of both blocks are walked together. Every pair
    of vectors is met once, so links add up. Vectors of different lengths have no cosine. Null, zero and non-finite vectors, those
    with null components and those with a null label link with nothing; equal rows are one vector; rows with one vec_id and
    different vectors are counted together, as one vertex; rows without vec_id link with nothing; an empty table gives no rows;
    other columns don't matter.
    """
    spark = vectors.sparkSession
    all_ = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    sound = F.size("embedding") > 0
    sound = sound & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = all_.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).distinct()
    rows = settle(rows.withColumn("width", F.size("embedding")), "vectors")
    total = rows.count()
    share = min(1.0, most_pivots / 2 / max(1, total), 1 / tree_rows)
    pick = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    pivots: dict = {}
    for r in rows.where(pick).limit(most_pivots).collect():  # at most most_pivots rows
        pivots.setdefault((r["label"], r["width"]), []).append(unit(np.array([r["embedding"]], np.float64))[0])
    held = spark.sparkContext.broadcast({k: np.array(v) for k, v in pivots.items()})

    def distances(u: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u @ p.T)))

    def assign(batches):
        for batch in batches:
            cell, gap = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, 2.0)
            for lab, width, at in by_kind(batch):
                if (p := held.value.get((lab, width))) is not None:
                    d = distances(unit(matrix(batch.column("embedding").take(pa.array(at)), width)), p)
                    cell[at], gap[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], names=[*batch.schema.names, "cell", "gap"])

    kind = dict(rows.dtypes)
    rows = settle(rows.mapInArrow(assign, f"vec_id long, label {kind['label']}, embedding {kind['embedding']}, width int, cell int, gap double"), "vectors")
    cells = settle(rows.groupBy("label", "width", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).withColumn("blocks", F.ceil(F.col("n") / tree_rows).cast("int")), "vectors")
    # Cells with pivots are as many as pivots at most; those without stand alone for their label.
    known = {k: (np.full(len(p), -4.0), np.zeros(len(p), np.int64), distances(p, p)) for k, p in held.value.items()}
    for r in cells.where("cell >= 0").collect():
        radius, blocks, _ = known[r["label"], r["width"]]
        radius[r["cell"]], blocks[r["cell"]] = r["radius"], r["blocks"]
    table_ = spark.sparkContext.broadcast(known)
    reach = sqrt(max(0.0, 2.0 - 2.0 * least)) + SLACK

    def spread(batches):
        for batch in batches:
            ids, cell, gap, blocks = (batch.column(n).to_numpy() for n in ("vec_id", "cell", "gap", "blocks"))
            mine = np.array([hash((d, 7)) % n for d, n in zip(ids.tolist(), blocks.tolist(), strict=True)], np.int64)
            at, cells_, parts = [], [], []
            for lab, width, own in by_kind(batch):
                c, g = cell[own], gap[own]
                if (p := held.value.get((lab, width))) is None:
                    row, other, number = np.arange(len(own)), c, blocks[own]
                else:
                    radius, sizes, between = table_.value[lab, width]
                    far = distances(unit(matrix(batch.column("embedding").take(pa.array(own)), width)), p)
                    # A vector of the other cell is nearer to its pivot: beyond the plane halfway, and within its cell's radius.
                    can = (far <= radius[None, :] + reach) & (far**2 - (g**2)[:, None] <= 2.0 * reach * between[c] + SLACK) & (sizes > 0)[None, :]
                    can[np.arange(len(own)), c] = True
                    row, other = np.nonzero(can)
                    number = sizes[other]
                row, other, number = np.repeat(row, number), np.repeat(other, number), number
                part = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(number)[:-1])), number)
                at.append(own[row])
                cells_.append(other)
                parts.append(part)
            if not at or not sum(map(len, at)):
                continue
            at, other, part = np.concatenate(at), np.concatenate(cells_), np.concatenate(parts)
            c, m = cell[at], mine[at]
            swap = (other < c) | ((other == c) & (part < m))
            take = batch.take(pa.array(at))
            one, two = np.where(swap, other, c), np.where(swap, c, other)
            arrays = [one, np.where(swap, part, m), two, np.where(swap, m, part), swap]
            for k in range(0, len(at), 4096):
                piece = take.slice(k, 4096)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("label"), piece.column("width"), *[pa.array(x[k : k + 4096].astype(np.int32)) for x in arrays], piece.column("vec_id"), piece.column("embedding")],
                    names=[*KEY, "half", "vec", "embedding"],
                )

    joined = rows.join(cells.select("label", "width", "cell", "blocks"), ["label", "width", "cell"]).select("label", "width", "embedding", "vec_id", "cell", "gap", "blocks")
    key = ", ".join(f"{k} {kind['label'] if k == 'label' else 'int'}" for k in KEY)
    spreaded = joined.mapInArrow(spread, f"{key}, half int, vec long, embedding {kind['embedding']}")
    links = settle(_blocks(spreaded, least), "vectors")
    near = components(links.select(F.col("vec").alias("a"), F.col("other").alias("b")), "vectors")
    counts = links.groupBy("vec").agg(F.sum("n").alias("n_links"))
    out = all_.select("vec_id").join(counts, F.col("vec_id") == F.col("vec"), "left").join(near, F.col("vec_id") == F.col("id"), "left")
    root = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

QUERIES = {"op5_embeddings": op5_embeddings}
ORACLE = {"op5_embeddings": ORACLE_SQL}
