"""Every registered query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from noteloom.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
SLOW = {"distill_run"}


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
