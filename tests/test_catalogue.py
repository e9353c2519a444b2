"""Every query with SQL gives what DuckDB gives; plans push filters and columns down."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rowloom import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown(spark):
    plan = catalogue.QUERIES["where_range"](spark, DATA)._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "l_extendedprice" not in plan.split("ReadSchema")[-1]
    assert "TakeOrderedAndProject" in catalogue.QUERIES["top_k"](spark, DATA)._jdf.queryExecution().toString()
