"""A hook for folding engines, and a plain scorer that stands in for one.

No thermodynamic engine is part of this library. A folder is any function from a sequence to (energy, structure); the default counts
stacked pairs of the best single stem and is not a free energy of a nucleic-acid model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Folder = Callable[[str], tuple[float, str]]
# Weights of paired letters; pairs of G and C count more than those of A and T, wobble pairs less.
PAIRS = {("G", "C"): -3.0, ("C", "G"): -3.0, ("A", "T"): -2.0, ("T", "A"): -2.0, ("A", "U"): -2.0, ("U", "A"): -2.0, ("G", "T"): -1.0, ("T", "G"): -1.0, ("G", "U"): -1.0, ("U", "G"): -1.0}


def best_stem(s: str, loop: int = 3) -> tuple[float, str]:
    """Energy and structure of the best run of stacked pairs around a loop of at least loop letters."""
    best, at = 0.0, None
    n = len(s)
    for centre in range(2 * n - 1):
        left, right = (centre - loop) // 2, (centre + loop + 1) // 2
        total, start = 0.0, None
        while left >= 0 and right < n:
            w = PAIRS.get((s[left], s[right]))
            if w is None:
                total, start = 0.0, None
            else:
                start = start or (left, right)
                total += w
                if total < best:
                    best, at = total, (start, (left, right))
            left, right = left - 1, right + 1
    out = ["."] * n
    if at:
        (i, j), (a, b) = at
        for k in range(i - a + 1):
            out[a + k], out[b - k] = "(", ")"
    return best, "".join(out)


def folded(df: DataFrame, key: str, seq: str, folder: Folder = best_stem, window: int | None = None, step: int = 1) -> DataFrame:
    """(key, at, energy, structure, stem): the whole sequence folded, or each window of it; equal pieces of a batch are folded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            known: dict[str, tuple[float, str]] = {}
            out = []
            for k, s in zip(rows["k"], rows["s"], strict=True):
                if s is None:
                    continue
                for at in range(0, max(1, len(s) - window + 1), step) if window else (0,):
                    piece = s[at : at + window] if window else s
                    if piece not in known:
                        known[piece] = folder(piece)
                    energy, structure = known[piece]
                    out.append((k, at, energy, structure, structure.count("(")))
            yield pd.DataFrame(out, columns=["k", "at", "energy", "structure", "stem"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(seq).alias("s")).mapInPandas(run, f"k {kind}, at long, energy double, structure string, stem long").withColumnRenamed("k", key)


def hairpin_flags(folds: DataFrame, key: str, stems: tuple[int, ...] = (11, 17, 21), energies: tuple[float, ...] = (-10.0, -15.0, -20.0)) -> DataFrame:
    """For each key the number of windows with stems longer, and energies lower, than each bound; one pass."""
    counts = [F.sum((F.col("stem") > n).cast("long")).alias(f"stem_{n}") for n in stems] + [F.sum((F.col("energy") < e).cast("long")).alias(f"energy_{abs(e):g}") for e in energies]
    return folds.groupBy(key).agg(F.max("stem").alias("longest"), F.min("energy").alias("least"), *counts)


def free_ends(structure: Column, n: int = 4) -> Column:
    """The last n letters are unpaired."""
    return F.right(structure, F.lit(n)) == "." * n
