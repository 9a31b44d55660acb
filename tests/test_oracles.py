"""Every query with an oracle gives the same rows as DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as E

D = "/root/testdata/sf0.001"
QUERIES, ORACLES = E.queries(), E.oracle_sql()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df, want = QUERIES[name](spark, D), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
