"""Composition rules and structure scans over sequences; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sequences as S

# Longest runs of one letter that pass, and tandem patterns that don't.
LONGEST_RUNS = {"A": 12, "C": 8, "G": 8, "T": 12}


def run_counts(s: Column, least: int) -> dict[str, Column]:
    """Number of runs of each letter with at least a length."""
    return {c: F.size(F.regexp_extract_all(s, F.lit(f"{c}{{{least},}}"), F.lit(0))).cast("long") for c in "ACGT"}


def quadruplex(s: Column, letter: str = "G") -> Column:
    """Number of stretches of three or more groups of three or more of a letter, up to seven others between them."""
    return F.size(F.regexp_extract_all(s, F.lit(f"{letter}{{3,}}(?:[ACGT]{{1,7}}{letter}{{3,}}){{2,}}"), F.lit(0))).cast("long")


def terminal_slippage(s: Column, k: int = 5, reach: int = 15) -> Column:
    """Some k-mer of the first reach letters occurs again in them, as it is or reverse complemented, without overlap."""
    head = F.left(s, F.lit(reach))
    at = F.sequence(F.lit(1), F.greatest(F.length(head) - k + 1, F.lit(1)))

    def hit(i: Column) -> Column:
        piece, rest = F.substring(head, i, F.lit(k)), F.substring(head, i + k, F.lit(reach))
        return rest.contains(piece) | rest.contains(S.reverse_complement(piece))

    return F.when(F.length(head) >= 2 * k, F.exists(at, hit)).otherwise(F.lit(False))


def hairpins(s: Column, stem: int, loops: tuple[int, int], mismatches: int = 0) -> Column:
    """Starts and loop lengths of stems: the letters after the loop pair with those before it, but for some mismatches."""
    n = F.length(s)
    at = lambda loop: F.transform(F.sequence(F.lit(1), F.greatest(n - 2 * stem - loop + 1, F.lit(1))), lambda i: F.struct(i.alias("at"), F.lit(loop).alias("loop")))
    every = F.concat(*[F.when(n >= 2 * stem + k, at(k)).otherwise(F.array().cast("array<struct<at:int,loop:int>>")) for k in range(loops[0], loops[1] + 1)])
    left = lambda x: F.substring(s, x["at"], F.lit(stem))
    right = lambda x: S.reverse_complement(F.substring(s, x["at"] + stem + x["loop"], F.lit(stem)))
    if not mismatches:
        return F.filter(every, lambda x: left(x) == right(x))
    return F.filter(every, lambda x: S.hamming(left(x), right(x)) <= mismatches)


def tandem(s: Column, unit: int, reach: int = 60) -> Column:
    """Starts of a unit that is at once repeated, within the first reach letters."""
    head = F.left(s, F.lit(reach))
    n = F.length(head) - 2 * unit + 1
    return F.when(n >= 1, F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(head, i, F.lit(unit)) == F.substring(head, i + unit, F.lit(unit)))).otherwise(F.array().cast("array<int>"))


def blacklisted_run(s: Column, longest: dict[str, int] = LONGEST_RUNS, edge: int = 1) -> Column:
    """A run of one letter longer than allowed, outside the first and last letters."""
    inside = F.substring(s, F.lit(edge + 1), F.length(s) - 2 * edge)
    return inside.rlike("|".join(f"{c}{{{n + 1},}}" for c, n in longest.items()))


def composition_passes(s: Column, window: int, low: float, high: float) -> Column:
    """The share of G and C of every window lies strictly between the bounds; strings shorter than a window pass."""
    return ~F.exists(S.window_shares(s, window, last=True), lambda x: (x <= low) | (x >= high))


# Window, least and most share of G and C, and the same for the first and last letters of longer sequences.
WINDOWS, ENDS = ((20, 0.15, 0.90), (100, 0.28, 0.76)), (60, 30, 0.24, 0.76)


def verdict(s: Column) -> Column:
    """All rules at once: composition of every window and of both ends, runs, slippage at the start."""
    ok = ~blacklisted_run(s) & ~terminal_slippage(s)
    for window, low, high in WINDOWS:
        ok = ok & composition_passes(s, window, low, high)
    longer, n, low, high = ENDS
    ends = composition_passes(F.left(s, F.lit(n)), n, low, high) & composition_passes(F.right(s, F.lit(n)), n, low, high)
    return ok & ((F.length(s) <= longer) | ends)
