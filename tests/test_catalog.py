"""Queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tarnwick import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no generated tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if sql := catalog.oracle_sql().get(name):
        got = duck.sql(sql)
        assert sorted(got.columns) == columns
        at = [got.columns.index(c) for c in columns]
        assert ours == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    else:
        assert ours
