"""Queries against their SQL statements in DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

TINY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TINY), reason="no test tables")
NAMES = sorted(n for n in entry.oracle_sql())


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.8g}") if v else 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat()[:10] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{TINY}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, TINY)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in got.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6)} <= set(entry.queries())
