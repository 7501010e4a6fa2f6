"""Every query of the engine against its SQL, at the smallest size."""

import glob
import os

import duckdb
import pytest
from conftest import DATA

from tokenlm.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(df):
    def one(v):
        if v is None or v != v:
            return "None"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)

    columns = sorted(df.columns)
    return columns, sorted(tuple(one(v) for v in r) for r in df[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, sql, name):
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(sql.sql(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0
