"""Filters and predicates that keep their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S


def in_lists(df: DataFrame, lists: dict[str, list]) -> DataFrame:
    """Rows whose value is listed, for every named column."""
    cond = F.lit(True)
    for name, values in lists.items():
        cond = cond & F.col(name).isin(values)
    return df.where(cond)


def not_in_lists(df: DataFrame, lists: dict[str, list]) -> DataFrame:
    """Rows that in_lists leaves out, those with nulls too."""
    cond = F.lit(True)
    for name, values in lists.items():
        cond = cond & F.coalesce(F.col(name).isin(values), F.lit(False))
    return df.where(~cond)


def checked_lists(df: DataFrame, lists: dict[str, list]) -> DataFrame:
    """in_lists, after making sure that every listed value occurs; raises ValueError otherwise."""
    for name, values in lists.items():
        found = {r[0] for r in df.where(F.col(name).isin(values)).select(name).distinct().collect()}
        if missing := [v for v in values if v not in found]:
            raise ValueError(f"{name} has no rows with {missing}")
    return in_lists(df, lists)


def ordered_lookup(keys: DataFrame, df: DataFrame, on: list[str], place: str = "place") -> DataFrame:
    """For each row of keys, which has a place, the rows of df equal to it; one row with nulls for a miss."""
    return keys.join(df, on, "left")


def drop_if_any(df: DataFrame, *bad: Column) -> DataFrame:
    """Rows for which no condition holds; a condition that is null doesn't hold."""
    cond = F.lit(False)
    for c in bad:
        cond = cond | F.coalesce(c, F.lit(False))
    return df.where(~cond)


def invalid_number(c: Column) -> Column:
    """Null, NaN, infinite or exactly 0: no measurement."""
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (c == 0)


def nonzero_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns with a value other than 0, found in one pass."""
    row = df.agg(*[F.max(F.coalesce(F.col(c) != 0, F.lit(False))).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def insert_column(columns: list[str], new: str, left: str | None = None, right: str | None = None) -> list[str]:
    """Column order with new after left, else before right, else last."""
    if left in columns:
        at = columns.index(left) + 1
    elif right in columns:
        at = columns.index(right)
    else:
        at = len(columns)
    return [*columns[:at], new, *columns[at:]]


def row_concat(columns: list[str], gap: str = "-") -> Column:
    """All columns in order, gap symbols taken out."""
    return F.replace(F.concat_ws("", *columns), F.lit(gap), F.lit(""))


def motif_conflicts(s: Column, motifs: list[str]) -> Column:
    """The excluded motifs that a sequence holds, or that hold it if it is shorter, in the order given."""
    each = [F.when(s.contains(m) | ((F.length(s) < len(m)) & F.lit(m).contains(s)), F.lit(m)) for m in motifs]
    return F.filter(F.array(*each), lambda m: m.isNotNull())


def edge_motifs(left: Column, right: Column, motifs: list[str]) -> Column:
    """Motifs that arise across the junction of two sequences: they overlap both."""
    out = []
    for m in motifs:
        l, r = F.right(left, F.lit(len(m) - 1)), F.left(right, F.lit(len(m) - 1))
        out.append(F.when(F.concat(l, r).contains(m), F.lit(m)))
    return F.filter(F.array(*out), lambda m: m.isNotNull())


def read_filter(s: Column, least: int, most_unknown: int = 10, least_letters: int = 4, unknown: str = "N") -> Column:
    """Why a read is left out, the first reason that holds: ambiguous (too many unknown letters), short, ambiguous (too few
    different letters); otherwise ok."""
    # Taking out all letters equal to the first, once less than there must be letters, leaves some.
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(least_letters - 1)), s, lambda r, _: F.replace(r, F.left(r, F.lit(1)), F.lit("")))
    return (
        F.when(F.length(s) - F.length(F.replace(s, F.lit(unknown), F.lit(""))) > most_unknown, "ambiguous")
        .when(F.length(s) < least, "short")
        .when(rest == "", "ambiguous")
        .otherwise("ok")
    )


def mean_quality_passes(qualities: Column, threshold: float) -> Column:
    return F.aggregate(qualities, F.lit(0.0), lambda a, x: a + x) / F.size(qualities) >= threshold


def low_complexity(s: Column, letters: str = "ACGT") -> Column:
    """di if two letters make up 75 %, mono if one makes up 50 %, tri if three make up all, else none; the first that holds."""
    n = F.length(s)
    counts = F.array_sort(F.array(*[n - F.length(F.translate(s, c, "")) for c in letters]))
    top = lambda k: sum((F.element_at(counts, -i - 1) for i in range(k)), F.lit(0))
    return F.when(top(2) >= 0.75 * n, "di").when(top(1) >= 0.5 * n, "mono").when(top(3) == n, "tri").otherwise("none")


def gc_between(s: Column, low: float, high: float) -> Column:
    return S.gc_content(s).between(low, high)


def sufficient_windows(s: Column, k: int, target: float) -> Column:
    """0-based starts of k-windows of a constraint whose product of degeneracies is under target."""
    return F.filter(F.transform(S.kmers(s, k), lambda w, i: F.when(S.degeneracy(w) < target, i)), lambda i: i.isNotNull())
