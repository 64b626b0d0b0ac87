"""Every query against its SQL on the smallest data set; queries without SQL must give rows."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def text(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "-"
    return f"{x:.5f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0 or name.startswith("p")
        return
    r = duck.sql(sql)
    assert sorted(r.columns) == columns
    order = [r.columns.index(c) for c in columns]
    assert got == sorted(tuple(text(x[i]) for i in order) for x in r.fetchall())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
