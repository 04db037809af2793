"""Every catalogue query that has SQL for the other engine against it, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from docloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(records):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(catalogue.ORACLES[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == columns
    want = [tuple(r[order.index(c)] for c in columns) for r in want.fetchall()]
    assert rows(map(tuple, got.select(columns).collect())) == rows(want)


def test_entry(spark):
    found = driver.entry(spark)
    assert found.count() == 200 and found.where("output_file IS NULL").count() == 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
