"""Every query with SQL against DuckDB over the same tables."""

import os

import duckdb
import pytest

from peakweave.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        path = f"{D}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    got = catalogue.queries()[name](spark, D).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    c = sorted(got.columns)
    rows = lambda df: sorted(tuple(repr(v) for v in r) for r in df[c].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_other_query_runs(spark, name):
    rows = catalogue.queries()[name](spark, D)
    assert rows.count() > 0 and len(rows.columns) == len(set(rows.columns))
