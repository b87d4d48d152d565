"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

from importlib import import_module
from pathlib import Path

import duckdb
import pytest

from seqspark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple(repr(x) for x in r) for r in rows)


NAMES = [(g, n) for g in catalog.GROUPS for n in import_module(f"seqspark.plans.{g}").QUERIES]


@pytest.mark.parametrize("group, name", NAMES, ids=[n for _, n in NAMES])
def test_query(spark, db, group, name):
    module = import_module(f"seqspark.plans.{group}")
    got = module.QUERIES[name](spark, FOLDER).toArrow()
    if (sql := module.ORACLE.get(name)) is None:
        assert got.num_columns
        return
    known = db.sql(sql)
    columns = sorted(known.columns)
    assert sorted(got.column_names) == columns
    rows = [[r[known.columns.index(c)] for c in columns] for r in known.fetchall()]
    assert plain(zip(*[got.column(c).to_pylist() for c in columns], strict=True)) == plain(rows)


def test_row_numbers_of_keys_with_gaps_and_repeats(spark):
    from types import SimpleNamespace

    from seqspark.plans.joins import j02

    keys = [5, 9, 9, 40, 1000, 1001, 70000, None]
    part = spark.createDataFrame([(k,) for k in reversed(keys)], "p_partkey long")
    supplier = spark.createDataFrame([(3 * k + k % 2, f"s{k}") for k in range(6)], "s_suppkey long, s_name string")
    got = sorted(tuple(r) for r in j02(SimpleNamespace(part=part, supplier=supplier)).collect())
    assert got == [(k, f"s{i}") for i, k in enumerate(keys[:6])]
