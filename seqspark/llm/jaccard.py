"""Exact joins of documents by the Jaccard similarity of their word shingles, with T-occurrence search in blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import merge
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, hot_keys, met, only, rest, settle, table
from .hashing import KNOWN, windows

SHINGLE = 3
PERCENT = 90
#: Bytes of text whose shingles are packed together, and characters whose shingles a task keeps the lists of.
CHUNK_BYTES, PART_CHARS = 8 << 20, 16 << 20
#: Bytes of text, and documents, that a block holds before its group is cut into several.
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 1024
#: Skew between a probe of a long list and a step of merging, as in the cost rule for the number of long lists.
MU = 0.0085


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(KNOWN.of(words), min(k, len(words))))


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of a set of n members with any set that is similar to it."""
    return -(-n * percent // 100)


def _u(kind, column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in column.to_pylist()]


#: Columns of what travels between texts and inverted lists: a chunk's share of the lists of a part, or a document of a chunk.
LISTS = "part int, chunk long, hashes binary, places binary, weights binary, doc_id long, place int, n long, digest binary, own long"
NAMES = [x.split(" ")[0] for x in LISTS.split(", ")]
#: Stands for several documents of a chunk.
SEVERAL = 0xFFFF


def _row(part: int, chunk: int, hashes: np.ndarray, places: np.ndarray, weights: np.ndarray) -> tuple:
    return part, chunk, hashes.tobytes(), places.astype(np.uint16).tobytes(), weights.astype(np.uint32).tobytes(), None, None, None, None, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)


def _pack(ids: list, texts: list, chunk: int, k: int, parts: int, detail: bool) -> list[tuple]:
    """Rows of a chunk of documents: for each part of the hash range the shingles with the place of the only document that holds them,
    or SEVERAL with their number; and a row for each document, whose own counts its shingles that others of the chunk hold."""
    sets = [shingles((t or b"").split(), k) for t in texts]
    held = [s if d is not None else s[:0] for s, d in zip(sets, ids, strict=True)]
    flat, place = np.concatenate(held), np.repeat(np.arange(len(held)), [len(s) for s in held])
    order = np.argsort(flat, kind="stable")
    flat, place = flat[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.empty(0, np.int64)
    count = np.diff(np.concatenate((first, [len(flat)])))
    many = np.repeat(count > 1, count)
    own = np.bincount(place[many], minlength=len(held))
    value, where_ = flat[first], np.where(count > 1, SEVERAL, place[first])
    part = ((value >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(part, np.arange(parts + 1)) if parts < len(part) else None
    low = (value & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    rows = []
    for p in range(parts) if bounds is not None else np.unique(part).tolist():
        a, b = (bounds[p], bounds[p + 1]) if bounds is not None else np.searchsorted(part, (p, p + 1))
        if a < b:
            w, c = where_[a:b], count[a:b]
            rows.append(_row(p, chunk, low[a:b], w, c[w == SEVERAL]))
    at = chunk % parts
    if detail and many.any():  # who they are, for the chunk itself
        token = np.repeat(part, count)[many].astype(np.uint64) << np.uint64(32) | flat[many] & np.uint64(0xFFFFFFFF)
        rows.append((at, chunk, token.tobytes(), place[many].astype(np.uint16).tobytes(), None, None, -1, None, None, None))
    for i, (d, s) in enumerate(zip(ids, sets, strict=True)):
        rows.append((at, chunk, None, None, None, d, i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, int(own[i])))
    return rows


def inverted(rows: DataFrame, k: int, parts: int, detail: bool) -> DataFrame:
    """(LISTS): for each chunk of rows (doc_id, text), which of its shingles other documents hold too.

    Chunks of documents send their distinct shingles, 4 bytes each beside the place of the document, to the task that keeps the
    inverted lists of that part of the hash range. Back come the shingles whose list is longer than one, with its length (detail), or
    only how many of them each document has. A shingle of all documents is sent once by each chunk. Two shingles that
    agree in 32 bits and the part count as one, which can only make more candidates.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("hashing")
        seq, key = 0, TaskContext.get().partitionId() << 24
        ids, texts, held = [], [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if texts and (held + len(t or b"") > CHUNK_BYTES or len(texts) >= SEVERAL - 1):
                    yield _batch(_pack(ids, texts, key | seq, k, parts, detail))
                    seq, ids, texts, held = seq + 1, [], [], 0
                ids.append(d)
                texts.append(t)
                held += len(t or b"")
        if texts:
            yield _batch(_pack(ids, texts, key | seq, k, parts, detail))
            ids, texts = [], []
        rest()

    def merge_lists(group: pa.Table) -> pa.Table:
        through = group.filter(pa.compute.is_valid(group.column("place")))
        lists = group.filter(pa.compute.is_null(group.column("place")))
        hashes, places, weights = _u(np.uint32, lists.column("hashes")), _u(np.uint16, lists.column("places")), _u(np.uint32, lists.column("weights"))
        out = []
        if hashes:
            ordered = np.sort(np.concatenate(hashes))
            shared = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], *[h[p == SEVERAL] for h, p in zip(hashes, places, strict=True)]]))
            counts = np.zeros(len(shared), np.int64)
            found = []
            for h, p, w in zip(hashes, places, weights, strict=True):
                at = np.minimum(np.searchsorted(shared, h), max(0, len(shared) - 1))
                mine = np.flatnonzero(shared[at] == h) if len(shared) else np.empty(0, np.int64)
                found.append((at[mine], mine))
                if detail:
                    n = np.ones(len(h), np.int64)
                    n[p == SEVERAL] = w
                    counts += np.bincount(at[mine], weights=n[mine], minlength=len(shared)).astype(np.int64)
            part = group.column("part")[0].as_py()
            for chunk, h, p, (at, mine) in zip(lists.column("chunk").to_pylist(), hashes, places, found, strict=True):
                if detail:
                    out.append(_row(part, chunk, h[mine], p[mine], np.minimum(counts[at], 0xFFFFFFFF)))
                else:
                    p = p[mine]
                    n = np.bincount(p[p != SEVERAL])
                    some = np.flatnonzero(n)
                    out.append(_row(part, chunk, h[:0], some, n[some]))
        return pa.concat_tables([through, pa.Table.from_batches([_batch(out)]).cast(through.schema)]) if out else through

    return rows.select("doc_id", "text").mapInArrow(pack, LISTS).groupBy("part").applyInArrow(merge_lists, LISTS)


def covered(rows: DataFrame, k: int, parts: int) -> DataFrame:
    """(doc_id, n, digest, held): for each row the size of its set, a digest of the set (null if empty), and how many of its shingles occur elsewhere."""

    def count(group: pa.Table) -> pa.Table:
        own = group.filter(pa.compute.is_valid(group.column("place")))
        rest = group.filter(pa.compute.is_null(group.column("place")))
        places = own.column("place").to_numpy()
        held = np.zeros(max(places, default=0) + 1, np.int64)
        held[places] = own.column("own").to_numpy()
        for p, w in zip(_u(np.uint16, rest.column("places")), _u(np.uint32, rest.column("weights")), strict=True):
            held[p] += w
        return pa.table({"doc_id": own.column("doc_id"), "n": own.column("n"), "digest": own.column("digest"), "held": held[places]})

    return settle(inverted(rows, k, parts, False).groupBy("chunk").applyInArrow(count, "doc_id long, n long, digest binary, held long"), "covered")


def shortest(rows: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """(doc_id, list): for each row that can have a similar one, its shortest inverted lists.

    Of the n lists of a set, similar sets share need(n) at least, so they meet in one of the n - need(n) + 1 shortest of both, lists
    being ordered by length and hash. Lists of one document only count among them but lead nowhere.
    """

    def choose(group: pa.Table) -> pa.Table:
        place = group.column("place").fill_null(-2).to_numpy()
        docs = group.filter(pa.array(place >= 0))
        ids, sizes = dict(zip(docs.column("place").to_pylist(), docs.column("doc_id").to_pylist(), strict=True)), dict(zip(docs.column("place").to_pylist(), docs.column("n").to_pylist(), strict=True))
        rest = group.filter(pa.array(place == -2))
        parts_ = [np.full(len(h), p, np.uint64) << np.uint64(32) | h for p, h in zip(rest.column("part").to_pylist(), _u(np.uint32, rest.column("hashes")), strict=True)]
        none = [np.empty(0, np.uint64)]
        token, where_, length = np.concatenate([*none, *parts_]), np.concatenate([*none, *_u(np.uint16, rest.column("places"))]).astype(np.int64), np.concatenate([*none, *_u(np.uint32, rest.column("weights"))]).astype(np.int64)
        several = where_ == SEVERAL
        pairs = group.filter(pa.array(place == -1))
        if pairs.num_rows:
            order = np.argsort(token[several])
            known, lengths = token[several][order], length[several][order]
            t, p = np.concatenate(_u(np.uint64, pairs.column("hashes"))), np.concatenate(_u(np.uint16, pairs.column("places")))
            token, where_, length = np.concatenate((token[~several], t)), np.concatenate((where_[~several], p.astype(np.int64))), np.concatenate((length[~several], lengths[np.searchsorted(known, t)]))
        order = np.lexsort((token, length, where_))
        token, where_ = token[order], where_[order]
        start = np.flatnonzero(np.concatenate(([True], where_[1:] != where_[:-1]))) if len(where_) else np.empty(0, np.int64)
        end = np.append(start[1:], len(where_))[: len(start)]  # none where no document of the chunk has lists left
        out_id, out_list = [], [token[:0]]
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            n = sizes[int(where_[a])]
            take = b - a - need(n, percent) + 1  # lists of one document stand before these
            if take > 0:
                out_id += [ids[int(where_[a])]] * take
                out_list.append(token[a : a + take])
        return pa.table({"doc_id": pa.array(out_id, pa.int64()), "list": np.concatenate(out_list).view(np.int64)})

    return settle(inverted(rows, k, parts, True).groupBy("chunk").applyInArrow(choose, "doc_id long, list long"), "lists")


class Lists:
    """Inverted lists of a block: for each shingle the places of the sets that hold it, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, codes = np.unique(flat, return_inverse=True)
        order = np.lexsort((owner, codes))
        self.places = owner[order]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(codes))))
        self.codes = np.split(codes, np.cumsum(self.sizes)[:-1]) if sets else []

    def search(self, q: int, percent: int, skip: np.ndarray) -> np.ndarray:
        """Places of the sets whose overlap with set q reaches what the similarity needs; those marked in skip aren't looked at.

        DivideSkip: of the lists of q's shingles, the L longest are left out of the merge. A set that occurs in T lists occurs in
        T - L of the others at least; what the merge of those finds so often is looked up in the long lists by binary search.
        """
        codes = self.codes[q]
        n = len(codes)
        need = -(-n * percent // 100)  # least overlap with a set of any size that can be similar
        lengths = self.start[codes + 1] - self.start[codes]
        order = np.argsort(lengths, kind="stable")
        longest = int(lengths[order[-1]])
        long_ = min(need - 1, max(int(need / (MU * log2(longest + 1) + 1)), 0))
        short, rest = codes[order[: n - long_]], codes[order[n - long_ :]]
        total = int(lengths[order[: n - long_]].sum())
        if total <= 256:
            runs = merge(*(self.places[self.start[c] : self.start[c + 1]].tolist() for c in short))
            got = [(p, len(list(g))) for p, g in groupby(runs)]
            found, count = np.array([p for p, _ in got], np.int64), np.array([c for _, c in got], np.int64)
        else:  # the same merge by counting places
            size = self.start[short + 1] - self.start[short]
            at = np.repeat(self.start[short] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)
            counts = np.bincount(self.places[at], minlength=len(self.sizes))
            found = np.flatnonzero(counts)
            count = counts[found]
        keep = (count >= need - long_) & ~skip[found] & (self.sizes[found] * 100 >= percent * n) & (n * 100 >= percent * self.sizes[found])
        found, count = found[keep], count[keep]
        if len(found):
            for c in rest:
                held = self.places[self.start[c] : self.start[c + 1]]
                at = np.searchsorted(held, found)
                count = count + (held[np.minimum(at, len(held) - 1)] == found)
        return found[100 * count >= percent * (n + self.sizes[found] - count)]


def linked(sets: list[np.ndarray], percent: int = PERCENT, queries: np.ndarray | None = None) -> list[int]:
    """For each set of a block the place of the first set that it is connected to by links within the block.

    Every set is a query, or those marked in queries; sets that are connected already needn't be compared again."""
    lists = Lists(sets)
    label = np.arange(len(sets))
    for q in range(len(sets)):
        if len(sets[q]) and (queries is None or queries[q]):
            for p in lists.search(q, percent, label == label[q]).tolist():
                if label[p] != label[q]:
                    a, b = sorted((label[p], label[q]))
                    label[label == b] = a
    return label.tolist()


def _blocks(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between ids that connect what is connected within each block of rows (block, doc_id, text, query)."""

    def run(block: pa.Table) -> pa.Table:
        asked: dict[tuple[int, str], bool] = {}
        for d, t, q in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), block.column("query").to_pylist(), strict=True):
            asked[d, t] = asked.get((d, t), False) or q
        rows = sorted(asked)
        ids = [d for d, _ in rows]
        label = linked([shingles((t or "").encode().split(), k) for _, t in rows], percent, np.array([asked[x] for x in rows], bool))
        pairs = [(ids[p], ids[i]) for i, p in enumerate(label) if p != i]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([x for _, x in pairs], pa.int64())})

    return rows.groupBy("block").applyInArrow(run, "a long, b long")


def _parts(rows: DataFrame) -> int:
    """Parts of the hash range: as many as tasks can run at once, more where there is more text."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-chars // PART_CHARS))


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs.

    Documents link when 100 * intersection >= percent * union of their sets of k-word shingles, lower-cased A-Z; the component
    is the smallest id reachable by links. Documents with the same set meet in one class. First go documents too few of whose
    shingles occur anywhere else; of what is left, similar sets meet in one of their shortest inverted lists, and what meets there,
    directly or by others, is a group. A group is one block, or several if
    it is large; in each block every document is searched for by T-occurrence. A group of several blocks has its smallest
    document in all of them, and every document that isn't connected to that one is searched for in all blocks, so no link is
    lost. Null and empty texts have an empty set and link with nothing; rows without id are alone, with a null component;
    rows with one id and the same text are one document (of different texts under one id, all link what they link);
    an empty table gives no rows. Texts are read whole.
    """
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), lower.alias("text"))
    known = covered(rows, k, _parts(rows))
    some = known.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = settle(some.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "classes")
    firsts = some.where(100 * F.col("held") >= percent * F.col("n")).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    left = settle(rows.join(settle(firsts, "firsts"), "doc_id", "left_semi"), "left")
    lists = shortest(left, k, percent, _parts(left))
    heads = settle(lists.groupBy("list").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").drop("b"), "heads")
    star = met(lists, heads.drop("n"), "list", hot_keys(heads, "list")).where("a < doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    groups = components(star, "groups")
    texts = settle(left.join(groups.withColumnRenamed("id", "doc_id"), "doc_id"), "jaccard")
    sizes = texts.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("bytes"))
    sizes = settle(sizes.select("component", "n", F.ceil(F.greatest(F.col("n") / block_docs, F.col("bytes") / block_bytes)).cast("int").alias("blocks")), "jaccard")
    placed = met(texts, sizes.drop("n"), "component", hot_keys(sizes, "component"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    name = lambda i: F.concat_ws(":", F.col("component"), i)
    inside = placed.withColumn("i", F.explode(F.when(F.col("doc_id") == F.col("component"), every).otherwise(F.array(own)))).select(name(F.col("i")).alias("block"), "doc_id", "text", F.lit(True).alias("query"))
    edges = settle(_blocks(inside, k, percent), "links")
    large = sizes.where("blocks > 1")
    if not large.isEmpty():
        near = components(edges, "links")
        apart = placed.where("blocks > 1").join(near.withColumnRenamed("component", "root"), placed["doc_id"] == near["id"], "left").where("root IS NULL OR root <> component")
        ask = apart.select("component", "blocks", "doc_id", "text").withColumn("i", F.explode(every)).select(name(F.col("i")).alias("block"), "doc_id", "text", F.lit(True).alias("query"))
        # Searched-for documents of a block that holds many are cut as well: each part meets the block's own documents.
        against = placed.where("blocks > 1").select(name(own).alias("block"), "doc_id", "text", F.lit(False).alias("query"))
        asked = ask.groupBy("block").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block_docs, F.sum(F.length("text")) / block_bytes)).cast("int").alias("turns"))
        turn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("turns")).cast("int")
        ask = ask.join(asked, "block").select(F.concat_ws(":", "block", turn).alias("block"), "doc_id", "text", "query")
        against = against.join(asked, "block").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select(F.concat_ws(":", "block", "t").alias("block"), "doc_id", "text", "query")
        edges = edges.unionByName(settle(_blocks(ask.unionByName(against), k, percent), "links"))
    roots = components(edges, "links")
    led = classes.join(roots.withColumnRenamed("id", "first"), "first", "left").select("digest", F.coalesce("component", "first").alias("of_class"), "n")
    led = settle(led, "classes")
    out = met(known.select("doc_id", "n", "digest"), led.drop("n"), "digest", hot_keys(led, "digest"), "left").join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "component", "doc_id")).alias("component_id"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS s FROM w),
t AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= 90 * (len(a.s) + len(b.s) - n)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id FROM s JOIN c USING (doc_id)"""

QUERIES = {"op9_jaccard": op9_jaccard}
ORACLE = {"op9_jaccard": ORACLE_SQL}
