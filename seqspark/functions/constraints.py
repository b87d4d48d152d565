"""Expressions over constraints, structures and pairs of sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sequences as S


def blocked(suffixes: Column) -> Column:
    """The next letters of a set of strings are all four: nothing can follow."""
    return F.size(F.array_distinct(F.transform(suffixes, lambda s: F.left(s, F.lit(1))))) == 4


def fixed_places(constraint: Column) -> Column:
    """0-based places of plain letters in a constraint."""
    chars = F.filter(F.split(constraint, "", -1), lambda c: c != "")
    return F.filter(F.transform(chars, lambda c, i: F.when(c.isin("A", "C", "G", "T"), i)), lambda i: i.isNotNull())


def without_fix(s: Column, fix: str, end: bool = False) -> Column:
    """The string without a prefix, or without a suffix."""
    has = s.endswith(fix) if end else s.startswith(fix)
    rest = F.left(s, F.length(s) - len(fix)) if end else F.substring(s, F.lit(len(fix) + 1), F.length(s))
    return F.when(has, rest).otherwise(s)


def longest_common(a: Column, b: Column, most: int) -> Column:
    """Length of the longest substring that both have, at most most; from long to short, so the first hit decides."""
    out = F.lit(0)
    for k in range(1, most + 1):
        out = F.when(F.arrays_overlap(S.kmers(a, k), S.kmers(b, k)), k).otherwise(out)
    return out


def trimmed_after(s: Column, constant: str) -> Column:
    """What follows the last exact occurrence of a constant; null without one."""
    return F.when(s.contains(constant), F.substring_index(s, constant, -1))


def nearest(constant: Column, n: int = 20, least: int = 6, from_end: bool = True) -> Column:
    """The n letters of a constant that lie nearest to what it frames; null if there are fewer than least."""
    return F.when(F.length(constant) >= least, F.right(constant, F.lit(n)) if from_end else F.left(constant, F.lit(n)))


def base_pairs(structure: Column) -> Column:
    """(i, j), 1-based, of each pair in a dot-bracket structure, by i; unbalanced brackets are left out."""
    chars = F.transform(F.filter(F.split(structure, "", -1), lambda c: c != ""), lambda c, i: F.struct((i + 1).alias("i"), c.alias("c")))
    ints, pairs = F.array().cast("array<int>"), F.array().cast("array<struct<i:int,j:int>>")

    def step(acc: Column, x: Column) -> Column:
        held = F.size(acc["open"]) > 0
        return F.struct(
            F.when(x["c"] == "(", F.concat(acc["open"], F.array(x["i"]))).when((x["c"] == ")") & held, F.slice(acc["open"], 1, F.greatest(F.size(acc["open"]) - 1, F.lit(0)))).otherwise(acc["open"]).alias("open"),
            F.when((x["c"] == ")") & held, F.concat(acc["pairs"], F.array(F.struct(F.element_at(acc["open"], -1).alias("i"), x["i"].alias("j"))))).otherwise(acc["pairs"]).alias("pairs"),
        )

    return F.array_sort(F.aggregate(chars, F.struct(ints.alias("open"), pairs.alias("pairs")), step, lambda a: a["pairs"]))


def dot_bracket(pairs: Column, n: Column) -> Column:
    """The dot-bracket structure of pairs over n letters."""
    at = F.sequence(F.lit(1), n)
    return F.array_join(F.transform(at, lambda k: F.when(F.exists(pairs, lambda p: p["i"] == k), "(").when(F.exists(pairs, lambda p: p["j"] == k), ")").otherwise(".")), "")


def warning_flags(pairs: Column, longest: int = 17) -> Column:
    """Which warnings hold: a pair that spans more than longest, no letter between pairs."""
    spans = F.exists(pairs, lambda p: p["j"] - p["i"] > longest)
    empty = F.exists(pairs, lambda p: p["j"] - p["i"] == 1)
    return F.filter(F.array(F.when(spans, "long"), F.when(empty, "empty")), lambda x: x.isNotNull())


def stems(structure: Column) -> Column:
    """(i, j, n): runs of n stacked pairs of a dot-bracket structure; (i, j), 1-based, is the outermost pair of a run."""
    pairs = base_pairs(structure)
    first = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["i"] == p["i"] - 1) & (q["j"] == p["j"] + 1)))
    # Pairs are in the order of i, so one pass follows a run to its end.
    run = lambda p: F.aggregate(pairs, F.lit(0), lambda n, q: F.when((q["i"] == p["i"] + n) & (q["j"] == p["j"] - n), n + 1).otherwise(n))
    return F.transform(first, lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"), run(p).alias("n")))


def stem_conflicts(structure: Column, homology: int) -> Column:
    """The stems of at least homology pairs: they force repeats of that length. Empty: no conflict."""
    return F.filter(stems(structure), lambda x: x["n"] >= homology)


def kinetic_score(structure: Column) -> Column:
    """(score, chance): the widest distance within a pair as a share of the length, and its power of -1.44 (1 without pairs); 0 and 1 of nothing."""
    widest = F.coalesce(F.array_max(F.transform(base_pairs(structure), lambda p: p["j"] - p["i"])), F.lit(0))
    return F.struct(F.coalesce(F.try_divide(widest, F.length(structure)), F.lit(0.0)).alias("score"), F.when(widest > 0, F.pow(widest, F.lit(-1.44))).otherwise(1.0).alias("chance"))


def motifs_within(element: Column, left: Column, right: Column, motifs: Column) -> Column:
    """The motifs that occur in an element between its neighbours, wholly or over an edge of it, but in neither neighbour alone."""
    new = lambda m: (
        F.contains(F.concat(F.right(left, F.length(m) - 1), element, F.left(right, F.length(m) - 1)), m)
    )
    return F.filter(motifs, new)


def splittable(regions: Column, length: Column, most: int, span: int) -> Column:
    """Whether fragments of at most `most` letters that overlap within variable regions (start, end; 0-based, in order) can cover a length.

    The first region must begin, and the last end, within a fragment of the respective edge, with span letters to overlap in; a
    fragment must reach over each gap, with span letters on both sides. Without regions nothing can be split."""
    inner = F.slice(regions, 2, F.greatest(F.size(regions) - 1, F.lit(0)))
    gaps = F.transform(inner, lambda r, k: r["start"] - F.element_at(regions, k + 1)["end"])
    reached = (F.get(regions, 0)["start"] + span <= most) & F.forall(gaps, lambda g: g + 2 * span <= most) & (F.element_at(regions, -1)["end"] - span + most >= length)
    return F.when(F.size(regions) > 0, reached).otherwise(F.lit(False))
