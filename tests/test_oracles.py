"""Every query runs on the smallest tables; those with a SQL twin give DuckDB's rows."""

import glob
import math
import os

import duckdb
import pytest

from kelpgraph import catalog

DATA = os.environ.get("KELP_TEST_DATA", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name not in ORACLES:
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == names
    places = [want.columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[k]) for k in places) for r in want.fetchall())


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
