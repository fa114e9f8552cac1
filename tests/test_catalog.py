"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quillon.plans import catalog

from .compare import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = rows(catalog.QUERIES[name](spark, SF).toPandas())
    want = rows(duck.execute(catalog.ORACLES[name]).df())
    assert got[0] == want[0]
    floats = [(g, w) for a, b in zip(got[1], want[1]) for g, w in zip(a, b) if g != w]
    assert len(got[1]) == len(want[1]) and not floats


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).count() == 1
