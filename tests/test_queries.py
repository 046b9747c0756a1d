"""Every query with SQL gives what DuckDB gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from pairloom.plans import reference_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(reference_queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    frame = reference_queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    found = duck.execute(reference_queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_every_query_has_sql():
    assert set(reference_queries.QUERIES) == set(reference_queries.ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() == 145
    assert set(entry.oracle_sql()) <= set(entry.queries())
