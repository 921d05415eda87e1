"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import numpy as np
import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def ordered(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind not in "fiub":
            df[c] = df[c].astype(str).replace({"nan": "None", "<NA>": "None", "NaT": "None"})
    return df.sort_values(list(df.columns), ignore_index=True)


def test_every_oracle_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    got, want = ordered(catalog.queries()[name](spark, DATA).toPandas()), ordered(con.sql(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind in "fiub" and want[c].dtype.kind in "fiub":
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=0, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert len(catalog.queries()[name](spark, DATA).columns) > 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
