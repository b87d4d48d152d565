"""How queries are registered: a function and the SQL that gives the same rows stand side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores: a file of narrow rows is small, so few tasks read it, however much work each row makes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def kept(df: DataFrame, key: str, row: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """(key, the fields of row) of the rows to keep. A filter would be pushed below what makes its columns, where all of it is worked out once
    more for each use, and by the few tasks that read the file."""
    return df.select(key, F.inline(F.filter(F.array(row), keep)))


class Group:
    """Queries of one subject. The decorated function takes (tables) and uses tables.name for a table of the folder."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(build):
            self.queries[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
            if sql:
                self.sql[name] = sql
            return build

        return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
