"""The registered queries against their SQL in DuckDB, where the test data is there."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted([show(r[i]) for i in order] for r in values)


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op")))
def test_query_equals_its_sql(spark, db, name):
    got = entry.queries()[name](spark, DATA)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert a == b and a


def test_entry(spark):
    assert entry.entry(spark).count() > 0
