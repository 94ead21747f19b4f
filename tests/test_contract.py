"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import norm

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


LARGER = "/root/testdata/sf0.01"


def views(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.fixture(scope="module")
def larger():
    return views(LARGER)


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def matches(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(norm(row[i]) for i in at) for row in rel.fetchall())
    got = sorted(tuple(norm(row[c]) for c in cols) for row in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, sf, con, name):
    matches(spark, sf, con, name)


@pytest.mark.parametrize("name", [n for n, sql in sorted(entry.oracle_sql().items())
                                  if " LIMIT " in sql])
def test_limits_match_sql_on_more_rows(spark, larger, name):
    matches(spark, LARGER, larger, name)


@pytest.mark.parametrize("name", ["window_classifier", "conversion_stats"])
def test_runs_without_sql(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["boosted_trees", "trained_ensemble"])
def test_fits_run_without_sql(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0
