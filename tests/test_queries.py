"""Every registered query that has SQL gives what DuckDB gives on the same tables."""

import decimal
import math
import os

import duckdb
import pytest

from brindle import registry
from conftest import SMALL


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    found = duck.sql(registry.SQL[name])
    columns = sorted(found.columns)
    assert sorted(df.columns) == columns
    want = sorted((tuple(plain(dict(zip(found.columns, r))[c]) for c in columns) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert sorted(entry.entry(spark).columns) == ["lines", "n_name", "revenue"]
