"""Every registered query with SQL gives the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

from cadence import catalog


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(float(v) if isinstance(v, float) else v for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist()), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, small, db, name):
    got, want = catalog.QUERIES[name](spark, small).toPandas(), db.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
