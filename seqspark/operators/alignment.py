"""Where patterns occur in texts with few edits, many rows at a time, and what reads hold between and beyond such places.

A column of the edit table is kept as differences, one bit a row of it, in 64-bit words; a step of all texts of a batch by one letter is
a few operations on whole arrays. Columns of these functions are pandas Series or lists of strings, as Arrow batches bring them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows worked on together: few enough for their columns to stay in a core's cache.
TOGETHER = 8192
SEED, SEED_EDITS, OVERLAP_EDITS, MOST_PLACES = 10, 4, 10, 10
SAMPLE = 50_000
_COMPLEMENT = str.maketrans("ACGTURYSWKMBVDHN", "TGCAAYRSWMKVBHDN")


def other_strand(s: str) -> str:
    return s.translate(_COMPLEMENT)[::-1]


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a padded matrix, and lengths."""
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(strings), int(n.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out, n


@dataclass
class Places:
    """Of each row the least distance, the first and last end of a place that has it (letters before the end), and how many ends have it."""

    distance: np.ndarray
    first: np.ndarray
    last: np.ndarray
    count: np.ndarray


def infix(patterns: list[str], texts: list[str], from_start: bool = False) -> Places:
    """The least edit distance of each pattern to any substring of its text, or to any beginning of it if from_start. An empty pattern
    is found everywhere; in an empty text nothing is, and the distance is the pattern's length."""
    out = Places(*(np.zeros(len(patterns), np.int64) for _ in range(4)))
    order = np.argsort([-len(t) for t in texts], kind="stable")
    for k in range(0, len(order), TOGETHER):
        at = order[k : k + TOGETHER]
        for name, values in zip(("distance", "first", "last", "count"), _swept([patterns[i] for i in at], [texts[i] for i in at], from_start), strict=True):
            getattr(out, name)[at] = values
    return out


def _swept(patterns: list[str], texts: list[str], from_start: bool) -> tuple[np.ndarray, ...]:
    """infix() of rows whose texts don't become longer."""
    p, m = _codes(patterns)
    t, n = _codes(texts)
    words = max(1, -(-p.shape[1] // 64))
    kinds, p = np.unique(p, return_inverse=True)
    p = p.reshape(len(m), -1)
    place = np.minimum(np.searchsorted(kinds, t), max(0, len(kinds) - 1))
    t = np.where(kinds[place] == t, place, len(kinds)) if len(kinds) else np.zeros(t.shape, np.int64)  # what no pattern has
    one, rows = np.uint64(1), np.arange(len(m))
    match = np.zeros((len(m), len(kinds) + 1, words), np.uint64)
    for i in range(p.shape[1]):
        own = np.flatnonzero(m > i)
        match[own, p[own, i], i // 64] |= one << np.uint64(i % 64)
    rise, fall = np.full((words, len(m)), ~np.uint64(0)), np.zeros((words, len(m)), np.uint64)
    top, high = (m - 1) // 64, np.where(m > 0, (m - 1) % 64, 0).astype(np.uint64)
    score = m.copy()
    best, first, last, count = m.copy(), np.zeros(len(m), np.int64), np.zeros(len(m), np.int64), np.zeros(len(m), np.int64)
    best[n > 0] = np.iinfo(np.int64).max
    long_enough = np.searchsorted(-n, -np.arange(t.shape[1]), side="left").tolist()  # rows whose text has a letter j
    with np.errstate(over="ignore"):
        for j, a in enumerate(long_enough):
            found = match[rows[:a], t[:a, j]]
            up = np.full(a, np.uint64(from_start))  # what comes in from the word above
            down = np.zeros(a, np.uint64)
            for w in range(words):
                pv, mv, eq = rise[w, :a], fall[w, :a], found[:, w]
                xv, eq = eq | mv, eq | down
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                here = top[:a] == w
                change = ((ph >> high[:a]) & one).astype(np.int64) - ((mh >> high[:a]) & one).astype(np.int64)
                score[:a] += np.where(here, change, 0)
                next_up, next_down = ph >> np.uint64(63), mh >> np.uint64(63)
                ph, mh = (ph << one) | up, (mh << one) | down
                rise[w, :a], fall[w, :a] = mh | ~(xv | ph), ph & xv
                up, down = next_up, next_down
            s, b = score[:a], best[:a]
            less, same = s < b, s == b
            best[:a] = np.minimum(s, b)
            first[:a] = np.where(less, j + 1, first[:a])
            last[:a] = np.where(less | same, j + 1, last[:a])
            count[:a] = np.where(less, 1, count[:a] + same)
    none = m == 0
    best[none], first[none], last[none], count[none] = 0, 0, n[none], n[none] + 1
    return best, first, last, count


def starts(patterns: list[str], texts: list[str], ends: np.ndarray) -> np.ndarray:
    """Where the place that ends at an end begins; of several beginnings with the least distance the leftmost."""
    back = infix([p[::-1] for p in patterns], [t[:e][::-1] for t, e in zip(texts, ends.tolist(), strict=True)], from_start=True)
    return ends - back.last


# Mates


def overlaps(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(length, edits) of the overlap of left's end with right's beginning, edits -1 where there is none.

    The last ten letters of left are looked for in right with four edits at most; the first of their nearest places, of which there may be ten
    at most, ends the overlap, which has at least ten letters. The overlap holds if what it covers of right differs from the end of left
    in ten letters at most, and no alignment within left that inserts or leaves out letters is nearer."""
    end, edits = np.zeros(len(left), np.int64), np.full(len(left), -1, np.int64)
    sizes = np.fromiter(map(len, left), np.int64, len(left))
    near = np.zeros(len(left), bool)  # with the seed at few places
    others = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if (at := y.find(seed := x[-SEED:])) >= 0:
            end[i], near[i] = at + len(seed), sum(y.startswith(seed, k) for k in range(at, len(y))) <= MOST_PLACES if y.find(seed, at + 1) >= 0 else True
        else:
            others.append(i)
    if others:
        seeds = infix([left[i][-SEED:] for i in others], [right[i] for i in others])
        end[others], near[others] = seeds.first, (seeds.distance <= SEED_EDITS) & (seeds.count <= MOST_PLACES)
    can = (sizes >= SEED) & near & (end >= SEED) & (end <= sizes)
    rows = np.flatnonzero(can)
    for k in range(0, len(rows), TOGETHER):
        at = rows[k : k + TOGETHER]
        x, y = (_codes(s)[0] for s in ([left[i][-end[i] :] for i in at], [right[i][: end[i]] for i in at]))
        edits[at] = (x != y).sum(1)
    edits[edits > OVERLAP_EDITS] = -1
    for i in np.flatnonzero(edits == 1).tolist():
        if right[i][: end[i]] in left[i]:
            edits[i] = -1
    if len(some := np.flatnonzero(edits > 1)):
        found = infix([right[i][: end[i]] for i in some], [left[i] for i in some])
        edits[some[found.distance < edits[some]]] = -1
    return end, edits


def _consensus(x: str, y: str, qx, qy) -> str:
    """x, with y's letter wherever they differ and y's quality is higher."""
    if x == y:
        return x
    out = list(x)
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        if a != b and qx[i] < qy[i]:
            out[i] = b
    return "".join(out)


def merge(r1: list, r2: list, q1: list, q2: list, inward: bool = True) -> list[str | None]:
    """Mates as one read each; r2 and q2 are on the strand of r1. Inward mates go from the outer ends to where they overlap, outward ones
    begin within each other, so only the overlap is kept. The kind that is named first is taken if it has no edits, otherwise the one with
    fewer; none if both have as many or neither overlaps. Reads without a mate stay as they are; null reads give null."""
    at = [i for i, (a, b) in enumerate(zip(r1, r2, strict=True)) if a is not None and b is not None]
    a, b = [r1[i] for i in at], [r2[i] for i in at]
    out: list[str | None] = [x if y is None else None for x, y in zip(r1, r2, strict=True)]
    end, first = overlaps(a, b) if inward else overlaps(b, a)
    ends, second = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
    left = np.flatnonzero(first != 0)
    x, y = [a[j] for j in left], [b[j] for j in left]
    ends[left], second[left] = overlaps(y, x) if inward else overlaps(x, y)
    inner, outer = (end, ends) if inward else (ends, end)
    use_first = (first == 0) | ((first > 0) & ((second < 0) | (first < second)))
    use_second = ~use_first & (second >= 0) & ((first < 0) | (second < first))
    for j, i in enumerate(at):
        if not (use_first[j] or use_second[j]):
            continue
        x, y, qx, qy = a[j], b[j], q1[i], q2[i]
        if use_first[j] == inward:
            n = int(inner[j])
            out[i] = x[:-n] + _consensus(x[-n:], y[:n], qx[len(x) - n :], qy[:n]) + y[n:]
        else:
            n = int(outer[j])
            out[i] = _consensus(x[:n], y[-n:], qx[:n], qy[len(y) - n :])
    return out


def merged(pairs: DataFrame, r1: str, r2: str, q1: str, q2: str, inward: bool | None = None, out: str = "merged") -> DataFrame:
    """pairs with the merged read, null where mates don't overlap. r2 and q2 are on the strand of r1, qualities strings or arrays. Unless
    told, which kind of overlap is tried first is what a sample says."""
    first = inward_first(pairs, r1, r2) if inward is None else inward

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        lists = [[None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v for v in s] for s in (a, b, x, y)]
        return pd.Series(merge(*lists, first), dtype="object")

    return pairs.withColumn(out, run(r1, r2, q1, q2))


def inward_first(pairs: DataFrame, r1: str, r2: str, sample: int = SAMPLE) -> bool:
    """Whether at least as many mates of a sample overlap better inward than outward; mates that do both equally well count for both.
    The sample is those pairs with the least hashes, so it's the same for every partitioning; pairs of equal mates count once each."""
    both = pairs.where(F.col(r1).isNotNull() & F.col(r2).isNotNull()).select(F.col(r1).alias("r1"), F.col(r2).alias("r2"))
    some = both.orderBy(F.xxhash64("r1", "r2"), "r1", "r2").limit(sample)

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = overlaps(a.tolist(), b.tolist())[1], overlaps(b.tolist(), a.tolist())[1]
        x, y = np.where(x < 0, 99, x), np.where(y < 0, 99, y)
        return pd.Series(np.where(x < y, 1, np.where(y < x, -1, 0)))

    return (some.select(F.sum(run("r1", "r2")).alias("s")).first()["s"] or 0) >= 0


# Anchors, constants and barcodes


def oriented(reads: list, anchor: str, errors: int) -> list[str | None]:
    """The strand of each read that holds the anchor: exactly, or else with the fewer edits, errors at most; none where both strands
    hold it alike, neither does, or the read is null or shorter than the anchor less errors."""
    back = other_strand(anchor)
    out: list[str | None] = [None] * len(reads)
    left = []
    for i, s in enumerate(reads):
        if s is None or len(s) < len(anchor) - errors:
            continue
        here, there = anchor in s, back in s
        if here != there:
            out[i] = s if here else other_strand(s)
        elif not here:
            left.append(i)
    if left and errors > 0:
        texts = [reads[i] for i in left]
        f, r = infix([anchor] * len(left), texts).distance, infix([back] * len(left), texts).distance
        for i, x, y in zip(left, f.tolist(), r.tolist(), strict=True):
            if x != y and min(x, y) <= errors:
                out[i] = reads[i] if x < y else other_strand(reads[i])
    return out


def trimmed(reads: list, const: str | None, errors: int, prefix: bool) -> list[str | None]:
    """What follows the last place of a prefix, or precedes the first of a suffix: of the exact ones, or else of those with the fewest edits,
    errors at most. None if there is no such place; without a constant reads stay as they are."""
    if const is None:
        return list(reads)
    out: list[str | None] = [None] * len(reads)
    left = []
    for i, s in enumerate(reads):
        if not s or len(s) < len(const) - errors:
            continue
        at = s.rfind(const) if prefix else s.find(const)
        if at >= 0:
            out[i] = s[at + len(const) :] if prefix else s[:at]
        else:
            left.append(i)
    if left and errors > 0:
        texts = [reads[i] for i in left]
        found = infix([const] * len(left), texts)
        good = np.flatnonzero(found.distance <= errors)
        ends = found.last[good] if prefix else found.first[good]
        cut = ends if prefix else starts([const] * len(good), [texts[g] for g in good], ends)
        for g, at in zip(good.tolist(), cut.tolist(), strict=True):
            out[left[g]] = texts[g][at:] if prefix else texts[g][:at]
    return out


@dataclass(frozen=True)
class Element:
    """Where a read holds a barcode: after prefix, before suffix, or between both (a constant may be missing). length is the barcode's,
    errors what the constants and the barcode may each have; the gaps are letters that part the barcode from the constants."""

    prefix: str | None
    suffix: str | None
    length: int
    errors: int = 0
    const_errors: int = 0
    anchor: str | None = None
    pre_gap: int = 0
    post_gap: int = 0

    @property
    def policy(self) -> float:
        """1: only the prefix is needed, 2: only the suffix, 1.5: both."""
        return 1.5 if self.prefix is not None and self.suffix is not None else 1.0 if self.suffix is None else 2.0

    def barcodes(self, reads: list) -> tuple[list[str | None], list[str | None]]:
        """(strand, barcode) of each read, null where the anchor or a needed constant is missing, or nothing is left. With one constant
        the barcode is cut to its length and errors more."""
        strand = oriented(reads, self.anchor or self.prefix or self.suffix, self.const_errors)
        cut, window = strand, self.length + self.errors
        if self.policy <= 1.5:
            cut = trimmed(cut, self.prefix, self.const_errors, True)
        if self.policy >= 1.5:
            cut = trimmed(cut, self.suffix, self.const_errors, False)
        if self.policy == 1.0:
            cut = [s[: window + self.pre_gap] if s else None for s in cut]
        if self.policy == 2.0:
            cut = [s[-window - self.post_gap :] if s else None for s in cut]
        return strand, [(s[self.pre_gap : len(s) - self.post_gap] or None) if s and len(s) > self.pre_gap + self.post_gap else None for s in cut]


@dataclass(frozen=True)
class Associate:
    """What a read must hold beside an element's barcode: the associate of the barcode's id, after prefix and before suffix (where they are
    given), with errors at most."""

    prefix: str | None = None
    suffix: str | None = None
    errors: int = 0
    const_errors: int = 0

    def regions(self, strands: list) -> list[str | None]:
        return trimmed(trimmed(strands, self.prefix, self.const_errors, True), self.suffix, self.const_errors, False)


def extracted(df: DataFrame, read: str, elements: dict[str, Element], associates: dict[str, Associate] | None = None) -> DataFrame:
    """df with the columns name_read (its strand) and name (its barcode) for each element, and name_region (where its associate is looked
    for) for each associate: one pass of Arrow batches for all."""
    associates = associates or {}
    kinds = ", ".join(f"{n}_read string, {n} string" + (f", {n}_region string" if n in associates else "") for n in elements)

    @F.pandas_udf(kinds)
    def run(s: pd.Series) -> pd.DataFrame:
        reads = [v if isinstance(v, str) else None for v in s]
        kind = {}
        for name, e in elements.items():
            kind[f"{name}_read"], kind[name] = strands, _ = e.barcodes(reads)
            if name in associates:
                kind[f"{name}_region"] = associates[name].regions(strands)
        return pd.DataFrame({k: pd.Series(v, dtype="object") for k, v in kind.items()})

    return df.withColumn("_found", run(read)).select(*df.columns, "_found.*")


def within(a: Column | str, b: Column | str, errors: Column | int) -> Column:
    """Whether the shorter of two strings lies in the longer with errors at most, insertions and omissions included; null for null. Exact
    ones are told by built-in functions where the caller does; here all are compared, in Arrow batches."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series, k: pd.Series) -> pd.Series:
        at = [i for i, (p, q, e) in enumerate(zip(x, y, k, strict=True)) if isinstance(p, str) and isinstance(q, str) and e == e and e is not None]
        pairs = [sorted((x[i], y[i]), key=len) for i in at]
        out = pd.Series([None] * len(x), dtype="object")
        if at:
            out.iloc[at] = [bool(v) for v in infix([p for p, _ in pairs], [q for _, q in pairs]).distance <= k.iloc[at].to_numpy(np.int64)]
        return out

    return near(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b, F.lit(errors) if isinstance(errors, int) else errors)
