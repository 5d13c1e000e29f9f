"""Registered queries against their SQL in DuckDB, over the smallest tables.

Streams are held against tables in ``test_streaming``; here run the queries that
read tables and scripts."""

import math
import os

import pytest

from tapeworks.plans import catalog

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in catalog.QUERIES if n in catalog.ORACLES and not n.startswith(("stream_", "state", "replayed"))]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "none"
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA), duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall()) and rows
