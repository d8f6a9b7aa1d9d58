"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from newsprint.plans.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("events", "documents", "pages", "labels", "benchmark")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return out


def plain(x):
    if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)):
        return "~"
    if isinstance(x, numbers.Number) and not isinstance(x, (bool, np.bool_)):
        return str(round(float(x), 6) + 0.0)
    return str(pd.Timestamp(x).date()) if hasattr(x, "year") else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_without_sql(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, DATA).count() > 0
