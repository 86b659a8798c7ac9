"""Every registered query of the main library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from ripplegraph.plans import code_queries, report_queries  # noqa: F401
from ripplegraph.plans.queries import ORACLES, QUERIES
from ripplegraph.sources.adapters import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return str(bool(v)) if isinstance(v, bool) else repr(round(float(v), 6)) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    got_rows = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    want_rows = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in want.fetchall())
    assert got_rows == want_rows
