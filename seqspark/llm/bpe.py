"""BPE encoding and decoding with a pair occurrence index over the distinct words of a partition."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import keeps, only, pieces, rest, table

#: Words in each of the two generations of a store in a Python worker; results don't depend on it.
MOST_WORDS = 200_000
#: Bytes of text that are encoded together: the pair index lies over their new words.
TEXT_BYTES = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Recent(dict):
    """What was set or taken lately. A full generation becomes the older one, and what is in the one before that is forgotten unless
    it was taken meanwhile: frequent words stay, words that come once go."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            dict.clear(self)

    def missing(self, keys: Iterable) -> list:
        """The distinct keys that aren't known; the others are held at least until the next turn but one."""
        out, older = [], self.older
        for k in dict.fromkeys(keys):
            if k not in self:
                if (x := older.get(k)) is not None:
                    self[k] = x
                else:
                    out.append(k)
        return out


class WordBpe:
    """Encodes as a tokenizer file says whose words end in a marker (lower case, white space dropped, byte letters).

    encode_words() takes all new words at once: the symbols of all words lie in one list with links to both neighbours, a map
    leads from each pair to all its positions, and a heap holds the ranks of the pairs that occur. The least rank is taken,
    every occurrence of its pair is merged from left to right, and the lists of the pairs to both sides are updated. Words
    don't touch each other, so this gives each word what a word-by-word encoder gives.
    """

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # A pair is one number, left * 2^20 + right; ranks are those of the file.
        self.merge = {self.vocab[a] << 20 | self.vocab[b]: (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.by_rank = list(self.merge)
        self.letters = byte_letters()
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.blank = regex.compile(r"\p{White_Space}+")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        # By word or piece: ids joined by spaces, what they decode to, their number.
        self.known, self.pieces = Recent(most_words), Recent(most_words)
        self.special = {i: self.entry([i]) for i in self.added.values()}

    def entry(self, ids: list[int]) -> tuple[str, str, int]:
        return " ".join(map(str, ids)), self.decode(ids), len(ids)

    def parts(self, word: str) -> list[str | int]:
        """What a word without white space falls into: ids of added tokens, and pieces for the merges."""
        if word.isascii() and word.isalpha():
            return [word.lower()]
        out: list[str | int] = []
        for part in self.marks.split(word) if self.marks and "<|" in word else [word]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                plain = part if part.isascii() else unicodedata.normalize("NFC", part)
                plain = plain.lower() if plain.isascii() else "".join(map(str.lower, plain))
                out += self.split.findall(plain)
        return out

    def encode_pieces(self, words: list[str]) -> list[list[int]]:
        letters, vocab, merge, by_rank = self.letters, self.vocab, self.merge, self.by_rank
        first, last = [vocab[x] for x in letters], [vocab[x + self.end] for x in letters]
        ids: list[int] = []
        bounds = [0]
        for w in words:
            row = w.encode("utf-8")
            ids += [first[b] for b in row]
            ids[-1] = last[row[-1]]
            bounds.append(len(ids))
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        for b in bounds[:-1]:
            before[b] = -1
        for b in bounds[1:]:
            after[b - 1] = -1
        at: dict[int, list[int]] = {}
        for i, j in enumerate(after):
            if j >= 0 and (p := ids[i] << 20 | ids[j]) in merge:
                if p in at:
                    at[p].append(i)
                else:
                    at[p] = [i]
        ranks = [merge[p][0] for p in at]
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            pair = by_rank[rank]
            if (places := at.pop(pair, None)) is None:
                continue
            left, right, new = pair >> 20, pair & 0xFFFFF, merge[pair][1]
            places.sort()
            for i in places:
                j = after[i]
                if j < 0 or ids[i] != left or ids[j] != right:
                    continue  # an earlier merge took one of the two
                ids[i], ids[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (p := new << 20 | ids[k]) in merge:
                        if p in at:
                            at[p].append(i)
                        else:
                            at[p] = [i]
                            heapq.heappush(ranks, merge[p][0])
                if (h := before[i]) >= 0 and (p := ids[h] << 20 | new) in merge:
                    if p in at:
                        at[p].append(h)
                    else:
                        at[p] = [h]
                        heapq.heappush(ranks, merge[p][0])
        return [[x for x in ids[a:b] if x >= 0] for a, b in zip(bounds, bounds[1:], strict=False)]

    def learn(self, words: list[str]) -> None:
        """Fill known for words."""
        held, special = self.pieces, self.special
        held.turn()
        parts = [self.parts(w) for w in words]
        if new := held.missing(p for row in parts for p in row if p not in special):
            for piece, ids in zip(new, self.encode_pieces(new), strict=True):
                held[piece] = self.entry(ids)
        for w, row in zip(words, parts, strict=True):
            got = [special[p] if p in special else held[p] for p in row]
            self.known[w] = got[0] if len(got) == 1 else (" ".join([x[0] for x in got]), " ".join([x[1] for x in got]), sum(x[2] for x in got))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included: a file without a decoder joins tokens by spaces."""
        return " ".join(map(self.text_of.__getitem__, ids))

    def words(self, text: str) -> list[str]:
        if re.search("[\x1c-\x1f]", text):  # white space to str.split() but not to the tokenizer
            return [w for w in self.blank.split(text) if w]
        return text.split()

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text: the number of ids, the decimal ids joined by spaces, and what they decode to. As decode() joins tokens by
        spaces, a text's ids decode to what its words' ids decode to, joined by spaces; words are decoded once."""
        rows = [self.words(t) if t else [] for t in texts]
        self.known.turn()
        if new := self.known.missing(w for row in rows for w in row):
            gc.disable()  # millions of short lists live at once; none form cycles
            try:
                self.learn(new)
            finally:
                gc.enable()
        out = []
        for row in rows:
            got = [x for w in row if (x := self.known[w])[2]]
            out.append((sum(x[2] for x in got), " ".join([x[0] for x in got]), " ".join([x[1] for x in got])))
        return out


_LOADED: dict[tuple[str, int], WordBpe] = {}
keeps("bpe", _LOADED.clear)


def loaded(path: str, most_words: int = MOST_WORDS) -> WordBpe:
    if (path, most_words) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, most_words] = WordBpe(path, most_words)
    return _LOADED[path, most_words]


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", full: bool = True, decoded: bool = True, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256), one row for each row of docs.

    Null and empty texts, and texts of white space, give no tokens and an empty decoded text. Whole texts are encoded,
    however long; repeated rows give repeated rows; an empty table gives none. decoded is the text of the ids; ids and decoded are
    null unless full, decoded also where it isn't asked for. most_words bounds what a Python worker remembers, not the result. path is that of the tokenizer file on every executor.
    """
    hexed = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("bpe")
        bpe = loaded(path, most_words)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in pieces(texts, TEXT_BYTES):
                got = bpe.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([x[0] for x in got], pa.int64()),
                        pa.array([np.fromstring(x[1], np.int32, sep=" ") if full else None for x in got], pa.list_(pa.int32())),
                        pa.array([x[2] if full and decoded else None for x in got], pa.string()),
                        pa.array([hexed(x[1]) for x in got], pa.string()),
                        pa.array([hexed(x[2]) for x in got], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"],
                )
                got = None  # the next texts are encoded without these
        rest()

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_path(), full=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op8_bpe": op8_bpe}
ORACLE: dict[str, str] = {}
