"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from sparrowmill import catalog
from sparrowmill.sources.views import TABLES

SF = "/root/testdata/sf0.001"
PLANS, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    def one(x):
        if x is None or x is pd.NA or x != x:
            return ""
        return f"{float(x) + 0.0:.6g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iufb" else str(x)

    return sorted(tuple(one(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_against_sql(spark, engine, key):
    got, want = PLANS[key](spark, SF).toPandas(), engine.sql(SQL[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("key", sorted(set(PLANS) - set(SQL)))
def test_query_without_sql_has_rows(spark, key):
    assert PLANS[key](spark, SF).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(PLANS)
