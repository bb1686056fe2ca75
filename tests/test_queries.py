"""Every surveillance query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidewatch.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple("-" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v).removesuffix(" 00:00:00") for v in r))  # dates come as timestamps from DuckDB
    return sorted(out)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 12
