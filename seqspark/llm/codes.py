"""Vector codes: codebooks for the parts of vectors, fitted by Lloyd's rounds that keep a heap of bounds for each entry."""

from __future__ import annotations

from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, discard, met, scratch, settle, table
from .integers import as_long, first_rows, floors, kept, limit, lists, squared, summed

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors whose heaps are kept together take about this many bytes.
CHUNK_BYTES = 2 << 20
SLACK = 1e-9


class Heaps:
    """The vectors of a chunk at one part position: for each entry a heap of (slack, row) of the rows assigned to it.

    A row's slack is the distance to its second nearest entry less that to its own, as of when the row was last looked at, plus what its
    entry's drift added up to then. The drift of an entry grows each round by how far it has moved and by how far any other has
    at most, so as long as a row's slack exceeds the drift, no other entry can be as near: the row keeps its entry unseen."""

    def __init__(self, heaps: list[list[tuple[float, int]]]):
        self.heaps = heaps

    @classmethod
    def stored(cls, slack: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> Heaps:
        pairs, ends = list(zip(slack.tolist(), row.tolist(), strict=True)), np.cumsum(sizes).tolist()
        return cls([pairs[a:b] for a, b in zip([0, *ends], ends, strict=False)])

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slacks and rows, heap by heap as they lie, and the sizes: what stored() takes."""
        pairs = [p for h in self.heaps for p in h]
        return np.array([p[0] for p in pairs], np.float64), np.array([p[1] for p in pairs], np.int32), np.array([len(h) for h in self.heaps], np.int32)

    def violated(self, drift: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and their entries so far, that are popped as their slack is used up."""
        rows, of = [], []
        for e, (heap, used) in enumerate(zip(self.heaps, drift, strict=True)):
            while heap and heap[0][0] <= used:
                rows.append(heappop(heap)[1])
                of.append(e)
        return np.array(rows, np.int64), np.array(of, np.int64)

    def push(self, rows: np.ndarray, entries: np.ndarray, slack: np.ndarray, drift: list[float]) -> None:
        for r, e, s in zip(rows.tolist(), entries.tolist(), slack.tolist(), strict=True):
            heappush(self.heaps[e], (s + drift[e], r))

    def entry_of(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        for e, heap in enumerate(self.heaps):
            out[[r for _, r in heap]] = e
        return out


def scanned(x: np.ndarray, entries: np.ndarray, piece: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties: the lower) by exact distances, and its slack: how much farther the second nearest is."""
    at, slack = np.empty(len(x), np.int64), np.empty(len(x))
    for k in range(0, len(x), piece):
        d = squared(x[k : k + piece], entries)
        at[k : k + piece] = d.argmin(1)
        if len(entries) == 1:
            slack[k : k + piece] = np.inf
            continue
        two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
        slack[k : k + piece] = two[:, 1] - two[:, 0] - SLACK * (1.0 + two[:, 1])
    return at, slack


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How much the slack of an entry's rows may shrink by the move of all entries; a little more, for rounding."""
    moved = np.sqrt(((after - before).astype(np.float64) ** 2).sum(1))
    if len(moved) == 1:
        return moved
    largest = np.argmax(moved)
    others = np.full(len(moved), moved[largest])
    others[largest] = np.delete(moved, largest).max()
    return (moved + others) * (1.0 + SLACK) + SLACK * (moved + others > 0)


class Chunk:
    """Some vectors, as a row of the state table holds them: integers, and the heaps of each part position once there are any."""

    def __init__(self, x: np.ndarray, heaps: list[Heaps] | None = None):
        self.x, self.heaps = x, heaps

    def settle_into(self, books: np.ndarray, drift: np.ndarray, changes=None) -> int:
        """Bring the heaps up to the codebooks: all rows in the first round, then those whose slack is used up. changes(part, rows,
        entries before or None, entries now) is told of it. Gives how many parts were looked at."""
        n, (parts, size, width), first, seen = len(self.x), books.shape, self.heaps is None, 0
        if first:
            self.heaps = [Heaps([[] for _ in range(size)]) for _ in range(parts)]
        for p in range(parts):
            used = drift[p].tolist()
            rows, was = (np.arange(n), None) if first else self.heaps[p].violated(used)
            if len(rows):
                now, slack = scanned(self.x[rows, p * width : (p + 1) * width], books[p])
                self.heaps[p].push(rows, now, slack, used)
                seen += len(rows)
                if changes:
                    changes(p, rows, was, now)
        return seen

    def codes(self) -> np.ndarray:
        return np.stack([h.entry_of(len(self.x)) for h in self.heaps], axis=1)


STATE = "width int, m binary, slack binary, row binary, sizes binary, part int, entry int, n long, s array<long>"


def _pack(ids: pa.Array, labels: pa.Array, chunk: Chunk) -> dict:
    """A row of the state table; integers take two bytes where they fit."""
    x = chunk.x.astype(np.int16 if np.abs(chunk.x).max(initial=0) < 1 << 15 else np.int32)
    flat = [h.flat() for h in chunk.heaps] if chunk.heaps else []
    blob = {k: (np.concatenate([f[i] for f in flat]).tobytes() if flat else None) for i, k in enumerate(("slack", "row", "sizes"))}
    return {"ids": ids, "labels": labels, "width": x.shape[1], "m": x.tobytes()} | blob


def _unpack(row: dict, n: int, width: int, parts: int, size: int) -> Chunk:
    x = np.frombuffer(row["m"], np.int16 if len(row["m"]) == 2 * n * row["width"] else np.int32).reshape(n, -1)
    x = np.clip(np.pad(x, ((0, 0), (0, width - x.shape[1]))).astype(np.int32), -limit(width), limit(width))
    if row["slack"] is None:
        return Chunk(x)
    slack, at, sizes = (np.frombuffer(row[k], t).reshape(parts, -1) for k, t in (("slack", np.float64), ("row", np.int32), ("sizes", np.int32)))
    return Chunk(x, [Heaps.stored(slack[p], at[p], sizes[p]) for p in range(parts)])


def _table(rows: list[dict], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch; ids and labels are Arrow arrays, one list each."""
    arrays = []
    for name in names:
        if name in ("ids", "labels") and (own := [r[name] for r in rows if r.get(name) is not None]):
            ends = np.cumsum([0, *(len(r[name]) if r.get(name) is not None else 0 for r in rows)]).astype(np.int32)
            values = pa.concat_arrays(own).cast(schema.field(name).type.value_type)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), values))
        else:
            arrays.append(pa.array([r.get(name) for r in rows], schema.field(name).type))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _chunks(batch: pa.RecordBatch, width: int, parts: int, size: int):
    """(ids, labels, chunk) of the rows of a batch of the state table."""
    blobs = batch.select(["width", "m", "slack", "row", "sizes"]).to_pylist()
    for i, row in enumerate(blobs):
        ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
        yield ids, labels, _unpack(row, len(ids), width, parts, size)


def encode_vectors(vectors: DataFrame, embedding: str = "embedding", label: str = "label", vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row for each vector that isn't null and has finite components only.

    A component x counts as floor(scale * x), held within limit(width) of 0 (134,217,728 for width 64) so that distances fit in a
    long; vectors shorter than the longest, or than a multiple of parts, count as if zeros followed. Each of the equal consecutive
    parts has a codebook, at first that part of the vectors of the entries least vec_ids (of several vectors of one vec_id the least;
    fewer entries if there are fewer). Each round assigns every part to the nearest entry, ties to the lower one, and moves each
    entry that is used to the floor of its parts' mean; then parts are assigned again. label_error adds the errors of equal labels,
    nulls and repeated rows included. Vectors without vec_id are encoded but don't start a codebook; where none has one, or none is kept, there are
    no rows; other columns don't matter.

    Vectors lie in chunks with their heaps. A round reads the chunks, looks only at the parts whose slack their entry's drift has
    used up, writes the chunks anew beside the changes of sums and counts, folded in each task, and then lets the older ones go; the driver
    has the codebooks and sums only.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, embedding, vec_id, F.col(f"`{label}`").alias("label"))
    kind = dict(rows.dtypes)["label"]
    schema_sql = f"ids array<long>, labels array<{kind}>, {STATE}"
    plain = spark.createDataFrame([], schema_sql)
    names, schema = plain.columns, plain.toArrow().schema
    empty = spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")

    def pack(batches):
        held, size = [], 0

        def out():
            batch = pa.Table.from_batches(held).combine_chunks()
            ids, labels, column = (batch.column(c).combine_chunks() for c in ("vec_id", "label", "embedding"))
            flat, lengths = lists(column)
            x = np.zeros((len(ids), int(lengths.max(initial=0))), np.int32)
            x[np.arange(x.shape[1]) < lengths[:, None]] = floors(flat, scale)
            return _table([_pack(ids, labels, Chunk(x))], names, schema)

        for batch in batches:
            longest = max(1, int(lists(batch.column("embedding"))[1].max(initial=0)))
            step = max(1, chunk_bytes // (4 * longest))
            for k in range(0, batch.num_rows, step):
                held.append(piece := batch.slice(k, step))
                size += piece.num_rows * longest * 4
                if size >= chunk_bytes // 2:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        df.write.parquet(path := scratch(spark, "codes"))
        return spark.read.schema(schema_sql).parquet(path), path

    start = first_rows(rows, F.col("vec_id"), entries)
    if not start:
        return empty
    state, path = written(rows.select("vec_id", "label", "embedding").mapInArrow(pack, schema_sql))
    width = max(1, state.agg(F.max("width")).first()[0])
    width = -(-width // parts) * parts
    first = np.zeros((len(start), width), np.int64)
    for i, v in enumerate(start):
        first[i, : len(v)] = floors(np.array(v, np.float64), scale)
    books = np.clip(first, -limit(width), limit(width)).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    size = len(start)
    sums, counts = [[[0] * (width // parts) for _ in range(size)] for _ in range(parts)], np.zeros((parts, size), object)
    drift = np.zeros((parts, size))

    for _ in range(rounds):

        def run(batches, books=books, drift=drift):
            n, s = np.zeros((parts, size), np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                for ids, labels, chunk in _chunks(batch, width, parts, size):

                    def changes(p, rows, was, now, chunk=chunk):
                        x = chunk.x[rows, p * books.shape[2] : (p + 1) * books.shape[2]]
                        moved = np.ones(len(rows), bool) if was is None else was != now
                        for to, sign in ((now, 1),) if was is None else ((now, 1), (was, -1)):
                            np.add.at(s[p], to[moved], sign * x[moved].astype(np.int64))
                            n[p] += sign * np.bincount(to[moved], minlength=size)

                    chunk.settle_into(books, drift, changes)
                    yield _table([_pack(ids, labels, chunk)], names, schema)
            some = np.argwhere((n != 0) | (s != 0).any(2))
            yield _table([{"part": int(p), "entry": int(e), "n": int(n[p, e]), "s": s[p, e].tolist()} for p, e in some], names, schema)

        chunks = state.where("part IS NULL")
        state, newer = written(chunks.mapInArrow(run, schema_sql))
        discard(spark, path)
        path = newer
        for r in summed(state.where("part IS NOT NULL").select("part", "entry", "n", "s"), "part", "entry"):  # parts * entries rows at most
            p, e = r["part"], r["entry"]
            counts[p, e] += r["n"]
            sums[p][e] = [a + int(b) for a, b in zip(sums[p][e], r["s"], strict=True)]
        now = books.copy()
        for p, e in np.argwhere(counts > 0):
            now[p, e] = [v // int(counts[p, e]) for v in sums[p][e]]
        drift = drift + np.stack([drifts(a, b) for a, b in zip(books, now, strict=True)])
        books = now

    def last(batches):
        for batch in batches:
            for ids, labels, chunk in _chunks(batch, width, parts, size):
                chunk.settle_into(books, drift)
                at = chunk.codes()
                near = books[np.arange(parts)[None, :], at].reshape(len(at), width)
                error = ((chunk.x.astype(np.int64) - near) ** 2).sum(1)
                digits = max(2, (size - 1).bit_length() + 3 >> 2)
                code = ["".join(f"{e:0{digits}x}" for e in row) for row in at.tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code), pa.array(error)], names=["vec_id", "label", "code", "error"])

    told = settle(state.where("part IS NULL").mapInArrow(last, f"vec_id long, label {kind}, code string, error long"), "codes")
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # A struct is never null, and null labels are equal within it.
    told = told.withColumn("of", F.struct("label"))
    by = settle(told.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("e")), "codes")
    total = by.agg(F.sum("n")).first()[0]
    hot = by.where(F.col("n") > F.lit(HOT_SHARE * total)).select("of")  # as many as one through the share at most
    out = met(told, by.select("of", as_long(F.col("e")).alias("label_error")), "of", hot)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(table(spark, sf_dir, "embeddings"))


_ASSIGN = """a{r} AS MATERIALIZED (
  SELECT vec_id, v.p, v.m, e, d FROM (
    SELECT v.vec_id, v.p, v.m, c.e, list_inner_product(v.m, v.m) + list_inner_product(c.c, c.c) - 2 * list_inner_product(v.m, c.c) AS d FROM v JOIN c{r} c USING (p)) v
  QUALIFY row_number() OVER (PARTITION BY vec_id, v.p ORDER BY d, e) = 1),"""
_MOVE = """c{n} AS MATERIALIZED (SELECT c.p, c.e, coalesce(x.c, c.c) AS c FROM c{r} c LEFT JOIN (
  SELECT p, e, list(x ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(m[i])::DOUBLE / count(*)) AS x FROM a{r}, range(1, 17) AS t(i) GROUP BY p, e, i) GROUP BY p, e) x USING (p, e)),"""
ORACLE_SQL = (
    """
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS m FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
v AS MATERIALIZED (SELECT vec_id, p, m[16 * p + 1 : 16 * p + 16] AS m FROM k, range(4) AS t(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 256),
c0 AS MATERIALIZED (SELECT p, e, m AS c FROM v JOIN f USING (vec_id)),
"""
    + "".join(_ASSIGN.format(r=r) + "\n" + (_MOVE.format(r=r, n=r + 1) + "\n" if r < 4 else "") for r in range(5))
    + """b AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c4),
o AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN k USING (vec_id), b"""
)

QUERIES = {"op11_codes": op11_codes}
ORACLE = {"op11_codes": ORACLE_SQL}
