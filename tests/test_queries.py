"""Every wiki query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from quillgraph.plans import oracles, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, tables, name):
    df = queries.queries()[name](spark, FOLDER)
    want = tables.sql(oracles.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).columns == ["source", "target"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
