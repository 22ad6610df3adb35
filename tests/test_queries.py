"""Each query against its SQL at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from parttrace.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="sample tables are not here")


def plain(df):
    def value(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else str(v)

    return sorted((tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    got, expected = QUERIES[name](spark, DATA).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and plain(got) == plain(expected)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
