"""Queries with SQL are held against DuckDB on the smallest tables; the others must run. Every fourth query by default, all
of them with ALL_QUERIES=1 (about a quarter of an hour)."""

import math
import os

import duckdb
import pytest

from slotloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracles()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


NAMES = sorted(QUERIES) if os.environ.get("ALL_QUERIES") else sorted(QUERIES)[::4]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    cols = sorted(df.columns)
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        expected = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
        assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in rows) == expected
