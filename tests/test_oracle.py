"""Each query against the same in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline import queries as own

QUERIES, ORACLE = own.Q, own.SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    text = lambda v: "null" if v is None or v != v else format(v, ".9g") if isinstance(v, float) else str(v)
    return [cols[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE[name])
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
