"""Language-model scores by prediction by partial matching over bytes, beside an add-one score over words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, keeps, met, only, settle, table

ORDER = 3
#: Byte strings that a task counts before it gives them on, and contexts of ORDER bytes that executors hold; what follows others is joined.
TASK_GRAMS, HELD_CONTEXTS = 1 << 22, 1 << 15
#: Bytes that never occur in UTF-8: before each text, and after it.
START, END = 0xFE, 0xFF
SYMBOLS = 255
CHUNK_BYTES, CHUNK_DOCS = 12 << 20, 1 << 15


def framed(text: bytes) -> bytes:
    return bytes([START]) * ORDER + text.lower() + bytes([END])


class Trie:
    """Byte contexts up to an order with the counts of what followed, as nested maps; plain and slow.

    probability() walks from the longest known context down: a symbol that followed there takes its share of total + distinct,
    otherwise distinct / (total + distinct) is spent on the escape, and what followed there is excluded from all shorter
    contexts; last, all symbols not excluded are alike. With learn() after each symbol the model is adaptive.
    """

    def __init__(self, order: int = ORDER):
        self.order, self.after = order, defaultdict(lambda: defaultdict(int))

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            self.after[context[len(context) - k :]][symbol] += 1

    def probability(self, context: bytes, symbol: int) -> float:
        out, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            if (known := self.after.get(context[len(context) - k :])) is None:
                continue
            open_ = {s: n for s, n in known.items() if s not in excluded}
            total = sum(open_.values())
            if not total:
                continue
            if symbol in open_:
                return out * open_[symbol] / (total + len(open_))
            out *= len(open_) / (total + len(open_))
            excluded |= open_.keys()
        return out / max(1, SYMBOLS - len(excluded))

    def code_length(self, text: bytes, adaptive: bool = True) -> float:
        """log10 probability of a text and its end."""
        data, out = framed(text), 0.0
        for i in range(ORDER, len(data)):
            context = data[i - self.order : i]
            out += log10(self.probability(context, data[i]))
            if adaptive:
                self.learn(context, data[i])
        return out


class Tables:
    """The same probabilities as a trained Trie, laid out for numpy: for each context a row of log10 probabilities of all symbols,
    escapes and exclusions already worked in. What follows a context also follows the contexts that it ends with, so the exclusion
    on the way down from a context depends on that context alone."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, lower: tuple | None = None):
        """Of all counts of byte strings; or of those of some contexts, with the whole counts of strings of three bytes (at least
        for what these contexts end with) and of two bytes in lower: then scores() leaves out what follows other contexts."""
        levels = [(codes, counts)]
        for k in (2, 1, 0):
            levels.append(lower[2 - k] if lower and k else shorter(*levels[-1], k))
        levels, self.partial = levels[::-1], lower is not None
        known = np.unique(np.concatenate([levels[1][0] >> np.uint32(s) & np.uint32(255) for s in (8, 0)]))
        self.index = np.full(256, len(known), np.int32)
        self.index[known] = np.arange(len(known))
        w = self.width = len(known) + 1
        level = np.zeros((1, w))
        level[0, self.index[levels[0][0]]] = levels[0][1]
        total, kinds = level.sum(), (level > 0).sum()
        tail = np.full((1, w), -log10(max(1, SYMBOLS - kinds)))
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(level > 0, np.log10(level / (total + kinds)), (np.log10(kinds / (total + kinds)) if total else 0.0) + tail)
        rows = [own.astype(np.float32)]
        self.node = np.zeros((w, w, w), np.int32)
        above = {"count": level, "tail": tail, "base": 0}
        for k in (1, 2, 3):
            codes, counts = levels[k]
            key = np.zeros(len(codes), np.int64)
            for j in range(k, 0, -1):
                key = key * w + self.index[codes >> np.uint32(8 * j) & np.uint32(255)]
            contexts, at = np.unique(key, return_inverse=True)
            n = len(contexts)
            count = np.zeros((n, w))
            count[at, self.index[codes & np.uint32(255)]] = counts
            digits = [contexts // w**j % w for j in range(k - 1, -1, -1)]
            base = self.own = sum(len(r) for r in rows)
            # The context that each ends with; where that has no table, the one below it.
            parent = self.node[(0,) * (4 - k) + tuple(digits[1:])] if k > 1 else np.zeros(n, np.int32)
            tail, own = np.empty((n, w)), np.empty((n, w), np.float32)
            for a in range(0, n, 2048):
                c, p = count[a : a + 2048], parent[a : a + 2048]
                pc, pt = self._of(above, p)
                seen = c > 0
                rest = np.where(seen, 0.0, pc)
                t, d = rest.sum(1, keepdims=True), (rest > 0).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    down = np.where(t > 0, np.where(rest > 0, np.log10(rest / (t + d)), np.log10(d / (t + d)) + pt), pt)
                    total, kinds = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
                    own[a : a + 2048] = np.where(seen, np.log10(c / (total + kinds)), np.log10(kinds / (total + kinds)) + down)
                tail[a : a + 2048] = down
            for i in range(n):
                self.node[(slice(None),) * (3 - k) + tuple(int(d[i]) for d in digits)] = base + i
            above = {"count": count, "tail": tail, "base": base, "under": above}
            rows.append(own)
        self.rows = np.concatenate(rows).ravel()

    @staticmethod
    def _of(level: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, tail = np.empty((len(ids), level["count"].shape[1])), np.empty((len(ids), level["count"].shape[1]))
        here = ids >= level["base"]
        count[here], tail[here] = level["count"][ids[here] - level["base"]], level["tail"][ids[here] - level["base"]]
        if not here.all():
            count[~here], tail[~here] = Tables._of(level["under"], ids[~here])
        return count, tail

    def scores(self, texts: list[bytes], left: list | None = None) -> np.ndarray:
        """log10 probability of each text and its end; what the tables don't hold is added to left: byte strings, places of texts."""
        if not texts:
            return np.empty(0)
        data = np.frombuffer(b"".join(map(framed, texts)), np.uint8)
        x = self.index[data]
        w = self.width
        code = (x[:-3].astype(np.int64) * w + x[1:-2]) * w + x[2:-1]
        node = self.node.ravel()[code].astype(np.int64)
        value = self.rows[node * w + x[3:]]
        value[data[3:] == START] = 0.0
        ends = np.cumsum([len(t) + ORDER + 1 for t in texts])
        if self.partial and len(other := np.flatnonzero((node < self.own) & (data[3:] != START))):
            value[other] = 0.0
            left.append((joined(data)[other], np.searchsorted(ends, other, "right")))
        return np.add.reduceat(value, np.concatenate(([0], ends[:-1])), dtype=np.float64)


def joined(data: np.ndarray) -> np.ndarray:
    """Each byte and the three after it as a number."""
    data = data.astype(np.uint32)
    return data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings of ORDER + 1 of framed texts, as numbers, and their counts."""
    data = np.frombuffer(b"".join(map(framed, texts)), np.uint8)
    return np.unique(joined(data)[data[3:] != START], return_counts=True)


def shorter(codes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of the last k + 1 bytes."""
    out, at = np.unique(codes & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
    return out, np.bincount(at, weights=counts, minlength=len(out))


def _chunks(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[list[tuple]]:
    held, n = [], 0
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for i, (d, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            t = texts[i].as_py() or b""
            if held and (n + len(t) > size or len(held) >= most):
                yield held
                held, n = [], 0
            held.append((d, t, h))
            n += len(t)
    if held:
        yield held


def train(rows: DataFrame) -> list[DataFrame]:
    """(code, n): written tables of the counts of all byte strings of 1, 2, 3 and 4 bytes of the rows that aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        for chunk in _chunks(batches, 4 << 20, CHUNK_DOCS):
            if learn := [t for _, t, h in chunk if not h]:
                c, n = grams(learn)
                codes, at = np.unique(np.concatenate((codes, c)), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate((counts, n)), minlength=len(codes)).astype(np.int64)
                if len(codes) > TASK_GRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["code", "n"])
                    codes, counts = codes[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["code", "n"])

    out = [settle(rows.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "ppm")]
    for k in (2, 1, 0):
        out.append(settle(out[-1].groupBy(_last("code", k + 1).alias("code")).agg(F.sum("n").alias("n")), "ppm"))
    return out[::-1]


def _last(code: str, n: int) -> Column:
    return F.col(code).bitwiseAND(F.lit((1 << 8 * n) - 1))


def _before(code: str, k: int) -> Column:
    """The k bytes before the last."""
    return F.shiftright(_last(code, k + 1), 8)


def held_tables(counts: list[DataFrame], most: int) -> tuple:
    """Arguments of Tables: all counts, if no more than most contexts are known, otherwise those of the most frequent contexts."""
    arrays = lambda df: (lambda t: (t.column("code").to_numpy().astype(np.uint32), t.column("n").to_numpy()))(df.select("code", "n").toArrow())
    contexts = settle(counts[3].groupBy(_before("code", 3).alias("context")).agg(F.sum("n").alias("all")), "ppm")
    if contexts.count() <= most:
        return arrays(counts[3])
    some = settle(contexts.orderBy(F.desc("all"), "context").limit(most).select("context"), "ppm")
    ends = some.select(_last("context", 2).alias("context")).distinct()
    of = lambda k, df: counts[k].withColumn("context", _before("code", k)).join(df, "context", "left_semi")
    return *arrays(of(3, some)), (arrays(of(2, ends)), arrays(counts[1]))


def probabilities(asked: DataFrame, counts: list[DataFrame]) -> DataFrame:
    """(code, value): log10 probabilities of the last byte after the three before it, for distinct byte strings (code), by joins with
    the counts of all orders; the same as Trie.probability."""
    log = lambda a, b: F.log10(a / b)
    total, kinds = counts[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    at, above = asked.select("code"), None
    at = at.withColumn("_c", _last("code", 1)).join(counts[0].select(F.col("code").alias("_c"), F.col("n").alias("n0")), "_c", "left").drop("_c")
    down = F.lit(-log10(max(1, SYMBOLS - kinds)))
    value = F.when(F.col("n0").isNotNull(), log(F.col("n0"), F.lit(total + kinds))).otherwise(down + (log10(kinds / (total + kinds)) if total else 0.0))
    for k in (1, 2, 3):
        # Of each context: how often it was seen, how many bytes follow it, and how often and how many others follow the shorter one.
        seen = counts[k].withColumn("_s", _last("code", k)).join(counts[k - 1].select(F.col("code").alias("_s"), F.col("n").alias("m")), "_s")
        seen = seen.groupBy(_before("code", k).alias("context")).agg(F.sum("n").alias(f"all{k}"), F.count(F.lit(1)).alias(f"kinds{k}"), F.sum("m").alias("m"))
        if above is None:
            seen = seen.withColumn("_t", F.lit(total)).withColumn("_d", F.lit(kinds))
        else:
            short = above.select(F.col("context").alias("_s"), F.col(f"all{k - 1}").alias("_t"), F.col(f"kinds{k - 1}").alias("_d"))
            seen = seen.withColumn("_s", _last("context", k - 1)).join(short, "_s")
        above = seen.select("context", f"all{k}", f"kinds{k}", (F.col("_t") - F.col("m")).alias(f"open{k}"), (F.col("_d") - F.col(f"kinds{k}")).alias(f"rest{k}"))
        at = at.withColumn("_c", _last("code", k + 1)).join(counts[k].select(F.col("code").alias("_c"), F.col("n").alias(f"n{k}")), "_c", "left").drop("_c")
        at = at.withColumn("context", _before("code", k)).join(above, "context", "left").drop("context")
        n, under, all_, kinds_, open_, rest = (F.col(f"{c}{i}") for c, i in (("n", k), ("n", k - 1), ("all", k), ("kinds", k), ("open", k), ("rest", k)))
        down = F.when(open_ > 0, F.when(under.isNotNull(), log(under, open_ + rest)).otherwise(log(rest, open_ + rest) + down)).otherwise(down)
        value = F.when(all_.isNull(), value).when(n.isNotNull(), log(n, all_ + kinds_)).otherwise(log(kinds_, all_ + kinds_) + down)
        # One column for each: the expressions would double with each order.
        at = at.withColumn("_v", value).withColumn("_w", down).select("code", f"n{k}", F.col("_v").alias(f"v{k}"), F.col("_w").alias(f"w{k}"))
        value, down = F.col(f"v{k}"), F.col(f"w{k}")
    return at.select("code", value.alias("value"))


def packed(doc: np.ndarray, times: np.ndarray, bounds: np.ndarray, n_docs: int) -> tuple[pa.Array, int]:
    """(doc, times) as bytes, a value for each range of bounds, and the width of a pair."""
    wide = 8 if len(doc) == 0 or times.max() > 65535 or n_docs > 65535 else 4
    data = np.stack((doc, times), 1).astype(np.uint32 if wide == 8 else np.uint16).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * wide).astype(np.int32)), pa.py_buffer(data)]), wide


_TABLES: dict = {}
keeps("ppm", _TABLES.clear)


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", modulus: int = 7, held: int = 2, held_contexts: int = HELD_CONTEXTS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    Rows whose crc32(id as text) mod modulus is held are held out, all others are learned from. score: log10 probability of the
    lower-cased (A-Z) bytes and the end under PPM of order 3, trained on all others; base_score: add-one unigrams of words and
    end. Counts of words are joined by word: each chunk of documents sends every word once, with the documents that hold it, so
    words travel by chunk and not by occurrence. Counts of byte strings of all orders are written tables without bound; what
    follows the most frequent contexts goes to all executors, and byte strings after other contexts are joined as words are, so
    scores don't turn on how many contexts are held. Null texts are empty and have the end only; a null id counts as empty text; repeated rows count and are scored
    each; with nothing to learn from, symbols are alike and n_known is 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    out_ = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == held
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), out_.alias("held_out"))
    strings = train(rows)
    model = spark.sparkContext.broadcast(held_tables(strings, held_contexts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ppm")
        if model.value is not _TABLES.get("of"):
            _TABLES.clear()
            _TABLES["of"], _TABLES["tables"] = model.value, Tables(*model.value)
        tables, part = _TABLES["tables"], TaskContext.get().partitionId()
        for seq, chunk in enumerate(_chunks(batches, chunk_bytes, CHUNK_DOCS)):
            key = part << 24 | seq
            ids: dict[bytes, int] = defaultdict()
            ids.default_factory = ids.__len__
            words, scores, lengths, left = [], [], [], []
            at, n, m = 0, 0, len(chunk)
            for i, (_, t, _) in enumerate(chunk):
                row = t.lower().split()
                lengths.append(len(row) + 1)
                words.append(np.fromiter(map(ids.__getitem__, row), np.uint32, len(row)))
                n += len(t)
                if n > 1 << 20 or i + 1 == m:  # pieces of about 1 MB, else a long text alone; what was read is let go
                    other: list = []
                    scores.append(tables.scores([x[1] for x in chunk[at : i + 1]], other))
                    left += [np.unique(c.astype(np.int64) * m + o + at, return_counts=True) for c, o in other]
                    for j in range(at, i + 1):
                        chunk[j] = (chunk[j][0], None, chunk[j][2])
                    at, n = i + 1, 0
            pair = np.repeat(np.arange(m), [len(x) for x in words])
            pair += np.concatenate(words).astype(np.int64) * m
            del words
            pair.sort()
            start = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
            times = np.diff(np.append(start, len(pair)))
            pair = pair[start]
            word, doc = pair // m, pair % m
            learn = np.array([not h for *_, h in chunk])
            train_n = np.bincount(word, weights=times * learn[doc], minlength=len(ids)).astype(np.int64)
            bounds = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(ids)))))
            blobs, wide = packed(doc, times, bounds, m)
            del pair, word, doc, times
            none = lambda k, t: pa.nulls(k, t)
            k = len(ids)
            if left:
                pair, at = np.unique(np.concatenate([p for p, _ in left]), return_inverse=True)
                times = np.bincount(at, weights=np.concatenate([t for _, t in left])).astype(np.int64)
                strings_, starts = np.unique(pair // m, return_index=True)
                o, (some, width) = len(strings_), packed(pair % m, times, np.concatenate((starts, [len(pair)])), m)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(o, key)), none(o, pa.binary()), none(o, pa.int64()), some, pa.array(np.full(o, width, np.int32)), none(o, pa.int64()), none(o, pa.bool_()), none(o, pa.int64()), none(o, pa.float64()), pa.array(strings_)], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, key)), pa.array(list(ids), pa.binary()), pa.array(train_n), blobs, pa.array(np.full(k, wide, np.int32)), none(k, pa.int64()), none(k, pa.bool_()), none(k, pa.int64()), none(k, pa.float64()), none(k, pa.int64())], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, key)), none(m, pa.binary()), none(m, pa.int64()), none(m, pa.binary()), pa.array(np.arange(m, dtype=np.int32)), pa.array([x[0] for x in chunk], pa.int64()), pa.array([x[2] for x in chunk], pa.bool_()), pa.array(lengths, pa.int64()), pa.array(np.concatenate(scores)), none(m, pa.int64())], names=names)

    names = ["chunk", "word", "n", "docs", "place", "doc_id", "held_out", "n_tokens", "score", "code"]
    kinds = "chunk long, word binary, n long, docs binary, place int, doc_id long, held_out boolean, n_tokens long, score double, code long"
    held_ = settle(rows.mapInArrow(run, kinds), "ppm")
    words, ends = held_.where("word IS NOT NULL").select("chunk", "word", "n", "docs", F.col("place").alias("wide")), held_.where("word IS NULL AND code IS NULL")
    counts = settle(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "ppm")
    tot = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end = ends.where("NOT held_out").count()
    n_all, kinds_all = tot[0] + end, tot[1] + (end > 0)

    def base(docs_: pa.Table, found_: pa.Table) -> pa.Table:
        n = docs_.num_rows
        order = docs_.column("place").to_numpy()
        total, hits, bytes_ = np.zeros(n), np.zeros(n, np.int64), docs_.column("score").to_numpy().copy()
        of_bytes = np.asarray(found_.column("of_bytes").to_numpy(zero_copy_only=False), bool)
        for known, bytewise in ((found_.filter(pa.array(of_bytes)), True), (found_.filter(pa.array(~of_bytes)), False)):
            if not known.num_rows:
                continue
            values = known.column("value").to_numpy()
            blobs, wide = known.column("docs").to_pylist(), known.column("wide").to_numpy()
            for width, kind in ((4, np.uint16), (8, np.uint32)):
                if (wide == width).any():
                    some = np.flatnonzero(wide == width)
                    flat = np.frombuffer(b"".join([blobs[i] for i in some]), kind).reshape(-1, 2).astype(np.int64)
                    value = np.repeat(values[some], [len(blobs[i]) // width for i in some])
                    each = np.bincount(flat[:, 0], weights=flat[:, 1] * value, minlength=n)
                    if bytewise:
                        bytes_ += each[order]
                        continue
                    total += each
                    hits += np.bincount(flat[:, 0], weights=flat[:, 1], minlength=n).astype(np.int64)
        tokens = docs_.column("n_tokens").to_numpy()
        result = total[order] + (log10(end + 1) if end else 0.0) - tokens * log10(n_all + kinds_all + 1)
        return pa.table({"doc_id": docs_.column("doc_id"), "held_out": docs_.column("held_out"), "n_tokens": tokens, "n_known": hits[order] + int(end > 0), "train_tokens": np.full(n, n_all, np.int64), "base_score": result, "score": bytes_})

    found = met(words, counts, "word", hot_keys(counts, "word", "c")).select(F.col("chunk").alias("of"), "docs", "wide", F.log10(F.col("c") + 1.0).alias("value"), F.lit(False).alias("of_bytes"))
    if len(model.value) > 2:
        codes = held_.where("code IS NOT NULL").select("chunk", "code", "docs", F.col("place").alias("wide"))
        values = probabilities(codes.select("code").distinct(), strings)
        found = found.unionByName(codes.join(values, "code").select(F.col("chunk").alias("of"), "docs", "wide", "value", F.lit(True).alias("of_bytes")))
    ends = ends.select("chunk", "place", "doc_id", "held_out", "n_tokens", "score")
    return ends.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(base, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op3_ppm": op3_ppm}
ORACLE: dict[str, str] = {}
