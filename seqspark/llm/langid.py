"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, pieces, rest, table

UNKNOWN = "und"
#: What the network is trained on: documents of each language at most, stretches of each document spread over its whole text.
SAMPLE_DOCS, SAMPLE_STRETCHES, LENGTH = 400, 4, 48
#: Training: steps for each sixteen languages, stretches of a step, first rate, seed.
STEPS, BATCH, RATE, SEED = 400, 128, 0.02, 11
HIDDEN = 12
#: A text is read in stretches, both ways from some bytes beyond each: states at a position follow from MARGIN bytes on either side at least.
STRETCH, MARGIN = 240, 24
#: Stretches read at once; with more languages than WIDE fewer, which changes memory only.
ROWS, WIDE = 1024, 16


def has_letter(text: str | None) -> bool:
    return bool(text) and (re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


def as_bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


class BiGru:
    """Two gated recurrent layers, one from each end, and a softmax over languages at every byte. Arrays are (time, unit, row)."""

    def __init__(self, n_out: int, alphabet: np.ndarray, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.hidden, self.index = hidden, np.zeros(256, np.uint8)  # place 0: bytes never seen
        self.index[alphabet] = np.arange(1, len(alphabet) + 1)
        draw = lambda a, b, s: (rng.standard_normal((a, b)) * s).astype(np.float32)
        self.p = {}
        for side in "fb":
            self.p[f"w{side}"] = draw(len(alphabet) + 1, 3 * hidden, 0.3)
            self.p[f"u{side}"] = draw(3 * hidden, hidden, 1 / np.sqrt(hidden))
            self.p[f"v{side}"] = draw(n_out, hidden, 0.3)
        self.p["c"] = np.zeros((n_out, 1), np.float32)

    def _run(self, x: np.ndarray, side: str, kept: list | None = None) -> np.ndarray:
        """States (time, hidden, n) of rows x (time, n), read from the first; kept gets what the way back needs."""
        w, u, k = self.p[f"w{side}"], self.p[f"u{side}"], self.hidden
        h, out = np.zeros((k, x.shape[1]), w.dtype), np.empty((len(x), k, x.shape[1]), w.dtype)
        for t in range(len(x)):
            gx, gh = w.take(x[t], axis=0).T, u @ h
            zr = gh[: 2 * k]
            zr += gx[: 2 * k]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            c = zr[k:] * gh[2 * k :]
            c += gx[2 * k :]
            np.tanh(c, out=c)
            if kept is not None:
                kept.append((h, zr[:k].copy(), zr[k:].copy(), c, gh[2 * k :].copy()))
            h = c + zr[:k] * (h - c)
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(time, languages, n) for rows x (time, n) of which the first lengths bytes count."""
        s = np.matmul(self.p["vf"], self._run(x, "f")) + self.p["c"]
        back = np.maximum(lengths[None, :] - 1 - np.arange(len(x))[:, None], 0)
        b = np.matmul(self.p["vb"], self._run(np.take_along_axis(x, back, 0), "b"))
        s += b[::-1] if (lengths == len(x)).all() else np.take_along_axis(b, back[:, None, :], 0)
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        return s / s.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes of rows x (n, time), each labelled with its text's language, and its gradients through time."""
        (n, length), x = x.shape, x.T
        kf, kb = [], []
        f, b = self._run(x, "f", kf), self._run(x[::-1], "b", kb)
        s = np.matmul(self.p["vf"], f) + np.matmul(self.p["vb"], b)[::-1] + self.p["c"]
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        loss = -np.log(np.maximum(s[:, y, np.arange(n)], 1e-12)).mean()
        s[:, y, np.arange(n)] -= 1
        s /= n * length
        g = {"c": s.sum((0, 2))[:, None]}
        for side, kept, states, error, bytes_ in (("f", kf, f, s, x), ("b", kb, b, s[::-1], x[::-1])):
            u, v, k = self.p[f"u{side}"], self.p[f"v{side}"], self.hidden
            g[f"v{side}"] = np.einsum("tln,thn->lh", error, states, optimize=True)
            back = np.matmul(v.T, error)
            gu, steps = np.zeros_like(u), np.empty((length, n, 3 * k), u.dtype)
            dh = np.zeros((k, n), u.dtype)
            for t in range(length - 1, -1, -1):
                h, z, r, c, ghc = kept[t]
                dh = dh + back[t]
                dz = dh * (h - c) * z * (1 - z)
                dc = dh * (1 - z) * (1 - c * c)
                dr = dc * ghc * r * (1 - r)
                dgh = np.concatenate((dz, dr, dc * r))
                steps[t] = np.concatenate((dz, dr, dc)).T
                gu += dgh @ h.T
                dh = dh * z + u.T @ dgh
            gw = np.zeros_like(self.p[f"w{side}"])
            np.add.at(gw, bytes_.ravel(), steps.reshape(-1, 3 * k))
            g[f"w{side}"], g[f"u{side}"] = gw, gu
        return float(loss), g

    def fit(self, rows: list[bytes], labels: np.ndarray, steps: int, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """rows: stretches of LENGTH bytes. Adam with a rate that falls to nothing."""
        rng = np.random.default_rng(seed)
        x = self.index[np.frombuffer(b"".join(rows), np.uint8)].reshape(len(rows), -1).astype(np.intp)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, order = [], np.empty(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate((order, rng.permutation(len(rows))))
            at, order = order[:batch], order[batch:]
            loss, g = self.gradients(x[at], labels[at])
            losses.append(loss)
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * v
                q[k] = 0.999 * q[k] + 0.001 * v * v
                slow = rate * (1 - (step - 1) / steps)
                self.p[k] -= (slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return losses

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """For each text the sum of its bytes' probabilities. Every byte is read, in stretches that overlap by MARGIN on both sides."""
        out = np.zeros((len(texts), len(self.p["c"])))
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        data = self.index[np.frombuffer(b"".join(texts), np.uint8)]
        number = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), number)
        core = (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * STRETCH
        low = np.maximum(core - MARGIN, 0)
        core_end = np.minimum(core + STRETCH, sizes[owner])
        length = np.minimum(core_end + MARGIN, sizes[owner]) - low
        order = np.argsort(length, kind="stable")
        rows = max(1, ROWS * WIDE // max(WIDE, out.shape[1]))
        for i in range(0, len(order), rows):
            at = order[i : i + rows]
            t = np.arange(length[at].max())[:, None]
            x = data[np.minimum((starts[owner[at]] + low[at])[None, :] + t, len(data) - 1)].astype(np.intp)
            inside = (t >= (core - low)[at][None, :]) & (t < (core_end - low)[at][None, :])
            s = self.probabilities(x, length[at])
            s *= inside[:, None, :]
            np.add.at(out, owner[at], s.sum(0).T)
        return out


def label(net: BiGru, languages: list[str], texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and its mean probability over all bytes for each text."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    some = [i for i, t in enumerate(texts) if has_letter(t)] if languages else []
    bodies = [as_bytes(texts[i]) for i in some]
    for i, body, got in zip(some, bodies, net.sums(bodies) if some else [], strict=True):
        best = int(got.argmax())
        out[i] = (languages[best], float(min(1.0, got[best] / len(body))))
    return out


def stretches(text: str | None, most: int = SAMPLE_STRETCHES, length: int = LENGTH) -> list[bytes]:
    """Parts of a text, spread over all of it; a text that is too short is repeated."""
    body = as_bytes(text)
    if not body:
        return []
    if len(body) < length:
        return [((body + b" ") * (length // len(body) + 1))[:length]]
    number = min(most, len(body) // length)
    return [body[i * (len(body) - length) // max(1, number - 1) :][:length] for i in range(number)]


def sample(docs: DataFrame, most_docs: int = SAMPLE_DOCS) -> tuple[list[str], list[tuple[str, bytes]]]:
    """All languages of docs (text, lang, key), and stretches of the texts with the most_docs least keys of each language.

    Equal keys are one text however often it is repeated, so a language gives all its texts or most_docs different ones, whatever its
    size. What reaches the driver is bounded by languages times most_docs."""
    some = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = some.select("lang", "key").distinct().withColumn("rank", rank).where(F.col("rank") <= most_docs).select("lang", "key").collect()
    least = docs.sparkSession.createDataFrame(chosen, "lang string, key long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(lang, key, i, x) for t, lang, key in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, x in enumerate(stretches(t))]
            if own:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True), kinds, strict=True)], names=["lang", "key", "i", "part"])

    cut = some.join(F.broadcast(least), ["lang", "key"]).select("text", "lang", "key").mapInArrow(run, "lang string, key long, i int, part binary")
    got = cut.groupBy("lang", "key", "i").agg(F.min("part").alias("part")).toArrow()
    return sorted({r["lang"] for r in chosen}), sorted(zip(got.column("lang").to_pylist(), got.column("part").to_pylist(), strict=True))


def trained(languages: list[str], parts: list[tuple[str, bytes]], most: int = SAMPLE_DOCS * SAMPLE_STRETCHES, seed: int = SEED) -> BiGru:
    """A network trained on at most most stretches of each language, drawn by seed. Languages with few are drawn more often, so
    that steps meet all alike."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[bytes]] = defaultdict(list)
    for lang, x in parts:
        by[lang].append(x)
    number = min(most, max(map(len, by.values()), default=0))
    chosen = [(by[lang][i], k) for k, lang in enumerate(languages) if by[lang] for i in (rng.choice(len(by[lang]), number, replace=False) if len(by[lang]) >= number else rng.integers(0, len(by[lang]), number))]
    alphabet = np.unique(np.frombuffer(b"".join(x for x, _ in chosen) or b"a", np.uint8))
    net = BiGru(max(1, len(languages)), alphabet, seed=seed)
    if chosen:
        net.fit([x for x, _ in chosen], np.array([k for _, k in chosen]), STEPS * -(-len(languages) // 16), seed=seed)
    return net


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", modulus: int = 4, held: int = 2, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) and the columns named in keep, one row for each row of docs.

    Learns from text and lang of rows whose crc32(id as text) mod modulus isn't held, on a bounded sample by hash of text, copies counted once. Every
    byte of every whole text, blanks and signs included, is labelled from both sides; a document's probabilities are the means over
    its bytes. Texts that are null or have no letter are und with score 0, and so are all if there is nothing to learn
    from. A null id counts as empty text; repeated rows give equal rows; an empty table gives none.
    """
    spark = docs.sparkSession
    keep = keep or []
    mark = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    out_ = F.pmod(mark, F.lit(modulus)) == held
    learn = docs.where(~out_).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(text), F.lit(SEED)).alias("key"))
    languages, parts = sample(learn)
    model = spark.sparkContext.broadcast((trained(languages, parts), languages))

    # A kept text travels once.
    sent = [F.col(doc_id).alias("_id"), out_.alias("_out"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]]
    last = len(sent)
    at = 2 + keep.index(text) if text in keep else last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("langid")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in pieces(texts):
                got = label(*model.value, texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array([x[0] for x in got]), pa.array([x[1] for x in got], pa.float64())], names=[*batch.schema.names[:last], "lang_pred", "score"])
        rest()

    taken = docs.select(*sent, *([] if text in keep else [F.col(text).alias("_text")]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:last])
    done = taken.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return done.select(F.col("_id").alias("doc_id"), F.col("_out").alias("held_out"), "lang_pred", "score", *[F.col(f"_k{i}").alias(f"keep_{c}") for i, c in enumerate(keep)])


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op6_langid": op6_langid}
ORACLE: dict[str, str] = {}
