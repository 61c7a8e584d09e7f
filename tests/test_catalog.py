"""Every query that has SQL agrees with DuckDB on the smallest tables; every query is stable under repartitioning of its session."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from tessera import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.load()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 50
    assert set(SQL) <= set(entry_module.oracle_sql()) and set(QUERIES) <= set(entry_module.queries())
