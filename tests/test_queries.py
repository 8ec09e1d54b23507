"""Every query with SQL against DuckDB on the smallest tables, and the driver contract."""

import os

import duckdb
import pytest

from weftlog.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(tuple(map(str, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
