"""Long passages that repeat across documents, by compaction of a de Bruijn graph of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, hot_keys, met, only, pieces, settle, table
from .hashing import KNOWN, sliding_least, windows

WINDOW = 50
ANCHOR = 16
#: Hashes that may clash before it must be a fault of another kind.
MOST_SEEDS = 4
#: What a row of the text pass holds: words of a path for those that repeat it, words of a branching edge, a document that may lose words.
PATH, BRANCH, DOCUMENT = 0, 1, 2


def paths(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run of windows that share their anchor, and the anchor's hash.

    A window of words is an edge of the de Bruijn graph. Its anchor is the place within it at which the hash of anchor words
    is least, the first of equals; where a text holds the same window, the anchor is the same. Consecutive windows with one
    anchor are a chain of edges, known by its words.
    """
    grams = windows(h, anchor)
    if len(h) < window:
        none = np.empty(0, np.int64)
        return none, none, grams[:0]
    bits = np.uint64(int(len(grams)).bit_length())
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_least((grams >> bits << bits) | place, window - anchor + 1)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return first, last, grams[at[first]]


def digest(words: bytes, seed: int, bits: int) -> int:
    """A signed number that stands for words joined by spaces; never 0, which stands for none."""
    full = int.from_bytes(hashlib.blake2b(words, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little", signed=True)
    return (full if bits >= 64 else full % (1 << bits)) or 1


EDGES = "doc_id long, mark int, n_words long, sha256 string, kept string, starts array<int>, counts array<int>, anchors array<long>, keys array<long>"


def chains(rows: DataFrame, window: int, seed: int, bits: int, full: bool) -> DataFrame:
    """One row for each row (doc_id, mark, text): number of words, digest of all words joined by a space, and the chains of edges
    of its windows in order: first window, number of windows, anchor, key of the words. Rows without id have no chains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("hashing")
        for batch in batches:
            ids, marks, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in pieces(texts):
                out: list[tuple] = []
                for i in range(a, b):
                    words = (texts[i] or b"").split()
                    whole = b" ".join(words)
                    row = (len(words), hashlib.sha256(whole).hexdigest(), whole if full else None)
                    if len(words) < window or not ids[i].is_valid:
                        out.append((*row, [], [], [], []))
                        continue
                    first, last, anchors = paths(KNOWN.of(words), window)
                    keys = [digest(b" ".join(words[s : e + window]), seed, bits) for s, e in zip(first.tolist(), last.tolist(), strict=True)]
                    out.append((*row, first, last - first + 1, anchors.view(np.int64), keys))
                kinds = [pa.int64(), pa.string(), pa.string(), *[pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64())]]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), marks.slice(a, b - a), *columns], names=[x.split(" ")[0] for x in EDGES.split(", ")])

    return settle(rows.mapInArrow(run, EDGES), "chains")


def repeated(edges: DataFrame) -> DataFrame:
    """(doc_id, mark, start, n, anchor, key, before, after): the chains whose anchor occurs in several documents, and the keys of the
    chains that touch them on both sides in their document, 0 for none. Only these chains can repeat, wholly or in part."""
    each = edges.where("size(starts) > 0").select("doc_id", "mark", F.inline(F.arrays_zip("starts", "counts", "anchors", "keys")))
    each = each.select("doc_id", "mark", F.col("starts").alias("start"), F.col("counts").alias("n"), F.col("anchors").alias("anchor"), F.col("keys").alias("key"))
    # Partial counts by task first: an anchor that a third of all documents hold is one row of each task.
    common = each.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("anchor", "n")
    common = settle(common, "anchors")
    some = met(each, common.select("anchor"), "anchor", hot_keys(common, "anchor"), "left_semi")
    order = Window.partitionBy("doc_id", "mark").orderBy("start")  # within one document
    before = F.when(F.lag("start").over(order) + F.lag("n").over(order) == F.col("start"), F.lag("key").over(order))
    after = F.when(F.lead("start").over(order) == F.col("start") + F.col("n"), F.lead("key").over(order))
    return settle(some.select("*", F.coalesce(before, F.lit(0)).alias("before"), F.coalesce(after, F.lit(0)).alias("after")), "repeated")


def nodes_of(chains_: DataFrame) -> DataFrame:
    """One row for each key: its source (smallest document, and the place there), the largest document, and the least and largest
    neighbour on both sides: one that is least and largest is the only one."""
    return settle(
        chains_.groupBy("key").agg(
            F.min(F.struct("doc_id", "mark", "start")).alias("source"), F.max("doc_id").alias("last"), F.min("anchor").alias("anchor"), F.min("n").alias("n"), F.count(F.lit(1)).alias("held"),
            F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("after").alias("a0"), F.max("after").alias("a1"),
        ),
        "nodes",
    )


def compacted(nodes: DataFrame) -> DataFrame:
    """(key, head, total): the nonbranching paths of the chains that repeat: the chain that each begins with, and its windows.

    Two chains are joined where the first is followed by nothing but the second and the second preceded by nothing but the first, in
    every document; the end of a document counts as a neighbour of its own, so there are no cycles. Pointers to the chain
    before are doubled by joins until all point to heads: as many rounds as the logarithm of the longest path.
    """
    shared = nodes.where("source.doc_id < last")
    ahead = shared.where("a0 = a1 AND a0 <> 0").select(F.col("key").alias("up"), F.col("a0").alias("key"))
    behind = shared.where("b0 = b1 AND b0 <> 0").select("key", F.col("b0").alias("up"))
    now, moved = settle(ahead.join(behind, ["key", "up"]), "paths"), True
    while moved:
        far = now.select(F.col("key").alias("up"), F.col("up").alias("far"))
        now = settle(now.join(far, "up", "left").select("key", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved")), "paths")
        moved = not now.where("moved").isEmpty()
        now = now.select("key", "up")
    led = shared.select("key", "n").join(now, "key", "left").select(F.coalesce("up", "key").alias("head"), "n")
    return led.groupBy("head").agg(F.sum("n").cast("int").alias("total"))


def branches(nodes: DataFrame) -> DataFrame:
    """The nodes whose anchor other chains have too: there the graph branches, and parts of chains may repeat though the whole doesn't."""
    forks = nodes.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("source.doc_id").alias("s"), F.max("last").alias("l")).where("a <> b AND s < l")
    return nodes.join(forks.select("anchor"), "anchor", "left_semi").select("key", "source", "n")


TEXTS = "kind int, key long, doc_id long, mark int, words string"


def read_texts(rows: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(kind, key, doc_id, mark, words): what asked (doc_id, mark, kind, key, start, n) wants of texts. Texts of other documents stay
    where they are if Spark finds the ids few enough to send them around."""
    ids = settle(asked.select("doc_id", "mark").distinct(), "ids")
    lists = asked.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("kind", "key", "start", "n")).alias("wants"))
    held = rows.join(ids, ["doc_id", "mark"], "left_semi").join(lists, ["doc_id", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_, marks, texts, wants = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3)
            for a, b in pieces(texts):
                out: list[tuple] = []
                for i in range(a, b):
                    words = (texts[i] or b"").split()
                    for w in wants[i].as_py():
                        part = words if w["kind"] == DOCUMENT else words[w["start"] : w["start"] + w["n"] + window - 1]
                        out.append((w["kind"], w["key"], ids_[i], marks[i], b" ".join(part)))
                if out:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in TEXTS.split(", ")])

    return settle(held.select("doc_id", "mark", "text", "wants").mapInArrow(run, TEXTS), "texts")


def branch_spans(texts: DataFrame, window: int, seed: int, bits: int) -> DataFrame:
    """(key, at, n, ref, place): the windows of branching chains that also start in a smaller document, in runs: n windows from the
    at-th of the chain on are those from place of chain ref."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in pieces(bodies, 1 << 20):
                rows = []
                for k, d, body in zip(keys[a:b], ids[a:b], bodies[a:b], strict=True):
                    words = body.split(b" ")
                    rows += [(k, d, i, digest(b" ".join(words[i : i + window]), seed, bits)) for i in range(len(words) - window + 1)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "doc_id", "at", "edge"])

    edges = texts.where(F.col("kind") == BRANCH).select("key", "doc_id", "words").mapInArrow(run, "key long, doc_id long, at int, edge long")
    first = edges.groupBy("edge").agg(F.min(F.struct("doc_id", "key", "at")).alias("s"), F.max("doc_id").alias("last")).where("s.doc_id < last")
    hits = edges.join(first, "edge").where("doc_id > s.doc_id").select("key", "at", F.col("s.key").alias("ref"), F.col("s.at").alias("place"))
    # A chain has as many windows as words between anchors: its runs are told apart within a few rows.
    order = Window.partitionBy("key", "ref", F.col("at") - F.col("place")).orderBy("at")
    runs = hits.withColumn("run", F.col("at") - F.row_number().over(order))
    return runs.groupBy("key", "ref", "run", (F.col("at") - F.col("place")).alias("_d")).agg(F.min("at").alias("at"), F.count(F.lit(1)).cast("int").alias("n"), F.min("place").alias("place")).select("key", "at", "n", "ref", "place")


def _cut(words: list[bytes], spans: list[tuple[int, int]], window: int) -> list[bytes]:
    """The words that no window of spans (first, number) covers."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n in spans:
        gone[s] += 1
        gone[s + n + window - 1] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]


def _removed(held: DataFrame, window: int, full: bool) -> DataFrame:
    """(doc_id, mark, left, cut_sha256, cut, clash) of rows with words and spans: the source's words are compared with the document's
    own, and where they differ a hash clashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, bodies, spans = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3)
            for a, b in pieces(bodies):
                out: list[tuple] = []
                for i in range(a, b):
                    words, clash, sure = bodies[i].split(b" "), False, []
                    for s in spans[i].as_py():
                        same = b" ".join(words[s["start"] : s["start"] + s["n"] + window - 1]) == s["words"].encode()
                        clash |= not same
                        if same:
                            sure.append((s["start"], s["n"]))
                    left = _cut(words, sure, window)
                    whole = b" ".join(left)
                    out.append((ids[i], marks[i], len(left), hashlib.sha256(whole).hexdigest(), whole if full else None, clash))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "mark", "left", "cut_sha256", "cut", "clash"])

    return settle(held.mapInArrow(run, "doc_id long, mark int, left long, cut_sha256 string, cut string, clash boolean"), "cut")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, full: bool = True, seed: int = 0, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): one row for each row of docs, without the words of any window of consecutive
    words that also starts in a document with a smaller id. kept is null unless full.

    Windows are edges of a de Bruijn graph; those of one anchor in a row are a chain, and chains that repeat are compacted to
    nonbranching paths by joins. A path or a part of a branching chain is known by its source: the smallest document and the
    place in it. The words there are brought to each repetition and compared with its own: should hashes of two documents clash
    (keys have bits bits), all is done again with the next seed and more bits. Null and empty texts have no words; documents
    shorter than a window lose nothing; rows without id lose nothing and are no source; rows with the same id are one document,
    which is no source for itself; an empty table gives no rows. Documents are read whole; what a task holds is a few MB of text
    and one long document.
    """
    mark = F.xxhash64(F.coalesce(docs[text], F.lit("")), F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), mark.alias("mark"), docs[text].alias("text"))
    base = chains(rows, window, seed, bits, full)
    some = repeated(base)
    nodes = nodes_of(some)
    heads = settle(compacted(nodes).withColumnRenamed("head", "key").join(nodes.select("key", "source", "held"), "key"), "heads")
    hot = hot_keys(heads, "key", "held")
    forks = settle(branches(nodes), "forks")
    where_ = ["doc_id", "mark", "start"]
    # A path is met where its head is; whoever holds the head holds the path.
    spans = met(some.select(*where_, "key"), heads.drop("held"), "key", hot).where(F.col("doc_id") > F.col("source.doc_id"))
    spans = settle(spans.select(*where_, F.col("total").alias("n"), F.lit(PATH).alias("kind"), F.col("key").alias("ref"), F.lit(0).alias("place")), "spans")
    wants = lambda df, kind, n: df.select("source.doc_id", "source.mark", F.lit(kind).alias("kind"), "key", "source.start", F.col(n).alias("n"))
    whole = lambda df: df.select("doc_id", "mark", F.lit(DOCUMENT).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("start"), F.lit(0).alias("n"))
    branching = wants(forks, BRANCH, "n")
    texts = read_texts(rows, wants(heads, PATH, "total").unionByName(branching).unionByName(whole(spans)).unionByName(whole(branching)), window)
    parts = settle(branch_spans(texts, window, seed, bits), "parts")
    own = some.select(*where_, "key").join(forks.select("key", F.col("source.doc_id").alias("doc_id")), ["key", "doc_id"], "left_semi").join(parts, "key")
    own = own.select("doc_id", "mark", (F.col("start") + F.col("at")).alias("start"), "n", F.lit(BRANCH).alias("kind"), "ref", "place")
    words = texts.where(F.col("kind") != DOCUMENT).select("kind", F.col("key").alias("ref"), "words").dropDuplicates(["kind", "ref"])
    # A path that very many documents repeat is there several times, for a share of them each.
    marked = lambda df: df.join(F.broadcast(hot.select(F.col("key").alias("ref"), F.lit(SALTS).alias("salts"))), "ref", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    words = marked(words).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    salted = marked(spans.unionByName(own)).withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.col("salts")).cast("int")).drop("salts")
    part = F.array_join(F.slice(F.split("words", " ", -1), F.col("place") + 1, F.col("n") + F.lit(window - 1)), " ")
    told = salted.join(words, ["kind", "ref", "salt"]).select(*where_, "n", F.when(F.col("kind") == PATH, F.col("words")).otherwise(part).alias("words"))
    told = told.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n", "words")).alias("spans"))
    held = texts.where(F.col("kind") == DOCUMENT).select("doc_id", "mark", "words").dropDuplicates(["doc_id", "mark"]).join(told, ["doc_id", "mark"])
    cut = _removed(held, window, full)
    if not cut.where("clash").isEmpty():
        if seed + 1 >= MOST_SEEDS:
            raise ValueError("hashes of words clash with every seed")
        return remove_repeats(docs, text, doc_id, window, full, seed + 1, min(64, bits * 4))
    out = base.select("doc_id", "mark", "n_words", "sha256", "kept").join(cut.drop("clash"), ["doc_id", "mark"], "left")
    return out.select("doc_id", "n_words", (F.col("n_words") - F.coalesce("left", "n_words")).alias("n_removed"), F.coalesce("cut_sha256", "sha256").alias("kept_sha256"), F.coalesce("cut", "kept").alias("kept"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), full=False).drop("kept")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 48, 1))) AS i, words FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM s),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS source FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM m WHERE source < doc_id),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda p: NOT list_contains(gone, p)), lambda p: words[p]) END AS kept FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM f"""

QUERIES = {"op4_substring": op4_substring}
ORACLE = {"op4_substring": ORACLE_SQL}
