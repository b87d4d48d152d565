"""Models over rows: registered functions of named columns, tables of coefficients, scans of configurations."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Form:
    """How a model's output is held against measurements."""

    x: str
    y: str
    scale: str = "linear"
    slope: float | None = None


@dataclass
class Models:
    """Models by name. A model takes pandas Series bound to upper-cased parameter names and returns one Series; defaults and fixed
    keyword arguments fill what the table lacks."""

    functions: dict[str, Callable] = field(default_factory=dict)
    fixed: dict[str, dict] = field(default_factory=dict)
    forms: dict[str, Form] = field(default_factory=dict)

    def add(self, model: Callable, name: str | None = None, **fixed) -> None:
        name = name or model.__name__
        if name in self.functions:
            raise ValueError(f"there is a model {name} already")
        self.functions[name], self.fixed[name] = model, fixed

    def remove(self, name: str) -> None:
        del self.functions[name], self.fixed[name]
        self.forms.pop(name, None)

    def rename(self, old: str, new: str) -> None:
        for kept in (self.functions, self.fixed, self.forms):
            if old in kept:
                kept[new] = kept.pop(old)

    def set_form(self, name: str, form: Form) -> None:
        self.forms[name] = form

    def __add__(self, other: Models) -> Models:
        return Models(self.functions | other.functions, self.fixed | other.fixed, self.forms | other.forms)

    def __sub__(self, names: list[str]) -> Models:
        return Models(*[{k: v for k, v in kept.items() if k not in names} for kept in (self.functions, self.fixed, self.forms)])

    def inputs(self, name: str, columns: list[str]) -> dict[str, str]:
        """Parameter: column, for those that a table has; an error if one without a default is missing."""
        have = {c.upper(): c for c in columns}
        out = {}
        for p in inspect.signature(self.functions[name]).parameters.values():
            if p.name in self.fixed[name]:
                continue
            if p.name.upper() in have:
                out[p.name] = have[p.name.upper()]
            elif p.default is p.empty:
                raise ValueError(f"{name} needs a column {p.name.upper()}")
        return out

    def predict(self, df: DataFrame, key: str, done: DataFrame | None = None) -> DataFrame:
        """(key, model, prediction) for every model and row, but for pairs in done. Each model gets only its columns, in Arrow batches;
        all models run in one pass over the table."""
        bound = {m: self.inputs(m, df.columns) for m in self.functions}
        needed = sorted({c for b in bound.values() for c in b.values()} - {key})
        functions, fixed = self.functions, self.fixed

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for name, columns in bound.items():
                    value = functions[name](**{p: rows[c] for p, c in columns.items()}, **fixed[name])
                    yield pd.DataFrame({key: rows[key], "model": name, "prediction": pd.Series(value, index=rows.index, dtype="float64")})

        kind = dict(df.dtypes)[key]
        out = df.select(key, *needed).mapInPandas(run, f"{key} {kind}, model string, prediction double")
        return out.join(done.select(key, "model"), [key, "model"], "left_anti") if done is not None else out


def lookup_sum(pieces: list[Column], tables: list[dict[str, float]]) -> Column:
    """Sum of one table value for each piece; absent pieces count 0. Tables are parameters and become literal maps."""
    out = F.lit(0.0)
    for piece, table in zip(pieces, tables, strict=True):
        out = out + F.coalesce(F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]), piece), F.lit(0.0))
    return out


def mismatch_energy(a: Column, b: Column, weights: list[float], scale: float = 2.3) -> Column:
    """Weighted number of places that differ, place 1 having the first weight."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(weights))), F.lit(0.0), lambda acc, i: acc + F.when(F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)), scale * F.element_at(w, i)).otherwise(0.0))


def rate(energy: Column, k: float = 1.0, beta: float = 1.0) -> Column:
    return F.lit(k) * F.exp(-F.lit(beta) * energy)


def configurations(df: DataFrame, length: Column, spacers: range, discs: range, upstream: int, downstream: int) -> DataFrame:
    """Adds at, spacer, disc: every place of a pair of boxes with a spacer and a discriminator between them that fits the sequence."""
    rows = df.withColumn("spacer", F.explode(F.array(*[F.lit(x) for x in spacers]))).withColumn("disc", F.explode(F.array(*[F.lit(x) for x in discs])))
    last = length - (upstream + F.col("spacer") + downstream + F.col("disc")) + 1
    return rows.where(last >= 1).withColumn("at", F.explode(F.sequence(F.lit(1), last)))
