"""Every registered query of the library proper against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from muniment.plans import registry

DATA = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(map(str, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).toPandas() is not None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
