"""Splitting of a table's sequences at shared places: letters vary there, and neighbouring fragments overlap in stretches that melt late
and differ between rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S

#: Entropy (base 4) up to which a place counts as constant.
CONSTANT = 0.25
_LETTERS = "ACGT"
#: Letters of a window that one number holds.
_CHUNK = 24
_ENTHALPY, _ENTROPY = (np.array([round(10 * t[a + b]) for a in _LETTERS for b in _LETTERS]) for t in (S.NEAREST_ENTHALPY, S.NEAREST_ENTROPY))


def column_entropy(df: DataFrame, seq: str) -> DataFrame:
    """(at, n, entropy): for each place (0-based) how many rows reach it, and the entropy of their letters, base 4. Null and empty
    sequences reach none. Letters are counted before they are shuffled."""
    each = df.select(F.posexplode(F.split(F.col(seq), "", -1)).alias("at", "letter")).where("letter <> ''")
    counts = each.groupBy("at", "letter").count()
    n = F.sum("count")
    return counts.groupBy("at").agg(n.alias("n"), F.greatest((F.ln(n) - F.sum(F.col("count") * F.ln("count")) / n) / log(4), F.lit(0.0)).alias("entropy"))


def variable_regions(entropy: DataFrame, gap: int, span: int) -> DataFrame:
    """(start, end): stretches of places (0-based, the end not included) that vary, joined over at most gap constant places, of at least
    span places. The windows hold a row for each place, as many as the longest sequence has letters."""
    order = Window.orderBy("at")
    some = entropy.where(F.col("entropy") > CONSTANT).select("at", (F.col("at") - F.lag("at").over(order) > gap + 1).cast("int").alias("first"))
    runs = some.select("at", F.sum(F.coalesce("first", F.lit(0))).over(order).alias("run")).groupBy("run")
    return runs.agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end")).where(F.col("end") - F.col("start") >= span).select("start", "end")


def least_melting(df: DataFrame, seq: str, length: int, span: int, most: int) -> DataFrame:
    """(q, w, melting): for each window of w letters (span to most) that ends before place q the least melting temperature over all rows.
    The first `length` letters of every row are read, all of them A, C, G or T; sums of tenths are exact, so rows' order doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        code = np.zeros(256, np.int64)
        code[np.frombuffer(_LETTERS.encode(), np.uint8)] = np.arange(4)
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                x = code[np.frombuffer("".join(t[:length] for t in part.column(0).to_pylist()).encode(), np.uint8)].reshape(-1, length)
                pair = 4 * x[:, :-1] + x[:, 1:]
                h, s = (np.pad(np.cumsum(t[pair], axis=1), ((0, 0), (1, 0))) for t in (_ENTHALPY, _ENTROPY))
                for w in range(span, most + 1):
                    dh, ds = (c[:, w - 1 :] - c[:, : length - w + 1] for c in (h, s))
                    tm = (100 * dh / (ds / 10 + 0.368 * log(0.05) * (w - 1) + 1.987 * log(5e-8 / 4)) - 273.15).min(0)
                    best[w] = np.minimum(best[w], tm) if w in best else tm
        for w, tm in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(w, length + 1)), pa.array(np.full(len(tm), w)), pa.array(tm)], names=["q", "w", "melting"])

    most = min(most, length)
    found = df.select(seq).mapInArrow(run, "q long, w long, melting double")
    return found.groupBy("q", "w").agg(F.min("melting").alias("melting"))


def _windows(df: DataFrame, seq: str, windows: list[tuple[int, int]]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(w).alias("w")) for q, w in windows]))
    return df.select(F.col(seq).alias("s"), each.alias("x")).select("x.q", "x.w", F.substring("s", F.col("x.q") - F.col("x.w") + 1, F.col("x.w")).alias("x"))


def near_pairs(df: DataFrame, seq: str, windows: list[tuple[int, int]], distance: int) -> DataFrame:
    """(q): a row wherever two rows whose windows (q, w) differ, but at fewer than distance places, meet by pairs of pieces. The size of
    what is made of narrow rows is guessed far too low: without the hint the driver would gather all of it for a broadcast."""
    n, w = distance + 1, F.col("w")
    bound = lambda i: F.floor(w * i / n).cast("int")
    piece = lambda i: F.substring("x", bound(i) + 1, bound(i + 1) - bound(i))
    pieces = F.array(*[F.struct(F.lit(k).alias("i"), F.concat(piece(i), piece(j)).alias("piece")) for k, (i, j) in enumerate(combinations(range(n), 2))])
    chunks = range(ceil(max(w for _, w in windows) / _CHUNK))
    number = lambda i: F.coalesce(F.conv(F.translate(F.substring("x", _CHUNK * i + 1, _CHUNK), _LETTERS, "0123"), 4, 10).cast("long"), F.lit(0))
    keys = _windows(df, seq, windows).select("q", F.inline(pieces), *[number(i).alias(f"c{i}") for i in chunks])
    a, b = keys.alias("a"), keys.alias("b")
    differ: Column = F.lit(0)
    for i in chunks:
        v = F.col(f"a.c{i}").bitwiseXOR(F.col(f"b.c{i}"))
        differ = differ + F.bit_count(v.bitwiseOR(F.shiftright(v, 1)).bitwiseAND(F.lit(int("01" * _CHUNK, 2))))
    less = F.struct(*[f"a.c{i}" for i in chunks]) < F.struct(*[f"b.c{i}" for i in chunks])
    met = (F.col("a.q") == F.col("b.q")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.piece") == F.col("b.piece")) & less & (differ < distance)
    return a.join(b.hint("merge"), met).select("a.q")


def too_near(df: DataFrame, seq: str, windows: list[tuple[int, int]], distance: int) -> set[int]:
    """The q of those windows (q, w) in which two rows differ at fewer than distance places.

    Equal windows are folded first. Windows nearer than distance have two of distance + 1 pieces in common, so the others meet by
    pairs of pieces; pairs of rows are compared where they meet and none leaves the join but the q of those that are too near."""
    if not windows:
        return set()
    same = _windows(df, seq, windows).groupBy("q", "x").count().where("count > 1").select("q").distinct()
    near = {r["q"] for r in same.collect()}
    rest = [(q, w) for q, w in windows if q not in near]
    if distance < 2 or not rest:
        return near
    return near | {r["q"] for r in near_pairs(df, seq, rest, distance).distinct().collect()}


class Overlaps:
    """For each place q the shortest overlap that can end before it: the greatest r so that (r, q) lies in a region, has span to most
    letters, melts at least at `melting` in every row, and differs at distance places or more between each two rows.

    Melting is worked out for all q at once; it alone gives `found`, in which r can only be too great. `settle` mends places by comparing rows:
    two rows that differ enough still do in a wider window, so widths are halved, for all asked q in the same jobs."""

    def __init__(self, df: DataFrame, seq: str, rows: int, length: int, regions: list[tuple[int, int]], melting: float, distance: int, span: int, most: int):
        self.df, self.seq, self.distance = df, seq, distance
        self.warm: dict[int, list[int]] = {}
        found: dict[int, set[int]] = {}
        for r in least_melting(df, seq, length, span, most).where(F.col("melting") >= melting).collect():
            found.setdefault(r["q"], set()).add(r["w"])
        least = next(w for w in range(span, most + distance + rows.bit_length()) if rows <= 4 ** (w - distance + 1))  # fewer letters haven't as many sequences that far apart
        for start, end in regions:
            for q in range(start + span, min(end, length) + 1):
                if widths := sorted(w for w in found.get(q, ()) if least <= w <= min(most, q - start)):
                    self.warm[q] = widths
        self.found = {q: q - widths[0] for q, widths in self.warm.items()}
        self.sure: set[int] = set()

    def settle(self, places: list[int]) -> None:
        new = [q for q in places if q in self.found and q not in self.sure]
        near = too_near(self.df, self.seq, [(q, self.warm[q][-1]) for q in new], self.distance)
        low = {q: 0 for q in new if q not in near}
        high = {q: len(self.warm[q]) - 1 for q in low}
        while wide := [q for q in low if low[q] < high[q]]:
            middle = {q: (low[q] + high[q]) // 2 for q in wide}
            close = too_near(self.df, self.seq, [(q, self.warm[q][m]) for q, m in middle.items()], self.distance)
            for q, m in middle.items():
                low[q], high[q] = (m + 1, high[q]) if q in close else (low[q], m)
        for q in new:
            if q in near:
                del self.found[q]
            else:
                self.found[q] = q - self.warm[q][low[q]]
        self.sure |= set(new)

    def cuts(self, length: int, limit: int) -> list[tuple[int, int]] | None:
        """fewest_cuts of what is found. Rows are compared only at the places of the best cuts so far, and at places before them, twice as many each time:
        what isn't compared can only turn out worse, so cuts of compared places alone are the best."""
        more = 0
        while (best := fewest_cuts(self.found, length, limit)) and any(q not in self.sure for _, q in best):
            self.settle(sorted({q - i for _, q in best for i in range(more + 1)}))
            more = 2 * more + 1
        return best


def fewest_cuts(found: dict[int, int], length: int, limit: int) -> list[tuple[int, int]] | None:
    """Overlaps (r, q) of neighbouring fragments of at most limit letters that cover a length, none reaching into the next; as few as
    can be, and of those the rightmost. None if there are none. Worked out from the right; the table has a row for each place."""
    need: dict[int, int] = {}  # q -> fragments after the one that ends at q
    follow = lambda r, last: [q for q in found if last < q <= r + limit and found[q] >= last and found[q] > r and q in need]
    for q in sorted(found, reverse=True):
        if found[q] + limit >= length:
            need[q] = 1
        elif after := follow(found[q], q):
            need[q] = 1 + min(need[p] for p in after)
    out, start, last = [], 0, 0
    while start + limit < length:
        if not (after := follow(start, last)):
            return None
        last = max(after, key=lambda q: (-need[q], q))
        start = found[last]
        out.append((start, last))
    return out


def reach_reason(regions: list[tuple[int, int]], length: int, limit: int, span: int) -> str | None:
    """Why fragments can't reach from region to region, or None."""
    if not regions:
        return "no variable region is long enough"
    if regions[0][0] + span > limit:
        return "the first variable region is too far from the beginning"
    if any(b[0] - a[1] + 2 * span > limit for a, b in zip(regions, regions[1:], strict=False)):
        return "variable regions are too far apart"
    if regions[-1][1] - span + limit < length:
        return "the last variable region is too far from the end"
    return None


def split_shared(df: DataFrame, seq: str, limit: int, melting: float, distance: int, shortest: int, longest: int) -> tuple[DataFrame | None, dict]:
    """df with `fragments`, an array of at most limit letters each, every second one as its reverse complement; and a status: the
    overlaps (r, q), regions, and why there are none if the first is None.

    All rows are cut at the same places. Rows must have at least limit letters and need the same number of fragments, lengths may differ by
    three quarters of limit at most; an empty table, a null or letters other than A, C, G and T raise ValueError. What the driver holds is
    bounded by the longest sequence times the longest overlap."""
    if distance < 1 or not 2 <= shortest <= longest:
        raise ValueError("distance must be at least 1, overlaps at least 2 letters")
    n = F.length(seq)
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("least"), F.max(n).alias("most"), F.count(F.when(F.col(seq).rlike("^[ACGT]+$"), 1)).alias("good")).first()
    if not r["rows"] or r["good"] < r["rows"]:
        raise ValueError("the table is empty" if not r["rows"] else f"{r['rows'] - r['good']} rows aren't letters of A, C, G and T")
    status: dict = {"overlaps": [], "regions": [], "reason": None}
    if r["least"] < limit:
        return None, status | {"reason": "sequences are shorter than the limit"}
    if limit - (r["most"] - r["least"]) < round(limit / 4):
        return None, status | {"reason": "lengths differ too much"}
    if ceil(r["least"] / limit) != ceil(r["most"] / limit):
        return None, status | {"reason": "sequences need different numbers of fragments"}
    span = max(distance, shortest)
    found = variable_regions(column_entropy(df, seq), min(3, distance // 4), span)
    status["regions"] = regions = sorted((x["start"], x["end"]) for x in found.collect())
    if reason := reach_reason(regions, r["most"], limit, span):
        return None, status | {"reason": reason}
    cuts = Overlaps(df, seq, r["rows"], r["least"], regions, melting, distance, span, longest).cuts(r["most"], limit)
    if cuts is None:
        return None, status | {"reason": "no overlaps meet both limits"}
    starts, ends = [0, *(a for a, _ in cuts)], [*(b for _, b in cuts), r["most"]]
    parts = [F.substring(seq, a + 1, b - a) for a, b in zip(starts, ends, strict=True)]
    parts = [S.reverse_complement(p) if i % 2 else p for i, p in enumerate(parts)]
    return df.withColumn("fragments", F.array(*parts)), status | {"overlaps": cuts}
