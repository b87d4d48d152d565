"""Word hashes for the operators that work on word windows in Python."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from .common import keeps

#: Words whose hashes a Python worker remembers; beyond that it forgets all and starts anew.
MOST_KNOWN = 300_000
BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit hashes of words; what was asked for before is looked up."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_KNOWN:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


KNOWN = WordHash()
keeps("hashing", KNOWN.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, in order; spans of doubled length are put together."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        span, power, width = h, BASE, 1
        out, used = None, 0
        n = len(h) - k + 1
        while True:
            if k & width:
                part = span[used : used + n]
                out = part.copy() if out is None else out * power + part
                used += width
            width *= 2
            if width > k:
                return mixed(out)
            span = span[: len(span) - width // 2] * power + span[width // 2 :]
            power = power * power


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w consecutive ones."""
    span, width = x, 1
    while width * 2 <= w:
        span = np.minimum(span[:-width], span[width:])
        width *= 2
    rest = w - width
    return np.minimum(span[: len(span) - rest], span[rest:]) if rest else span
