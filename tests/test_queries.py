"""Every query with SQL gives that SQL's rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cinderlog import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(x):
    if isinstance(x, float) and math.isfinite(x) and x == int(x):
        return int(x)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(x) for x in r) for r in df.select(*columns).collect()], key=str)
    if name in catalog.SQL:
        result = duck.sql(catalog.SQL[name])
        assert sorted(result.columns) == columns
        want = sorted([tuple(plain(x) for x in r) for r in result.select(", ".join(f'"{c}"' for c in columns)).fetchall()], key=str)
        assert got == want
    else:
        assert got


@pytest.mark.parametrize("name", ["stream_rollup", "stream_limited"])
def test_streams_of_more_than_a_few_bodies_hold(spark, duck, monkeypatch, name):
    from cinderlog import bodies
    from cinderlog.operators import validate

    # eight bodies of all events would be beyond this limit
    monkeypatch.setattr(validate, "MAX_BODY_BYTES", 15_000)
    monkeypatch.setattr(bodies, "PER_FILE", 50, raising=False)
    test_query(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
