"""Collects the queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package with QUERIES (name -> function of session and folder) and ORACLE (name -> SQL).
GROUPS: tuple[str, ...] = ("filters", "windows", "joins", "statistics", "scoring", "more", "pipelines", "further", "feasible", "reading")


def _merged(name: str) -> dict:
    out: dict = {}
    for group in GROUPS:
        out |= getattr(import_module(f"{__package__}.{group}"), name)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["j06_shared_kmer_pairs"](spark, sf_dir)
