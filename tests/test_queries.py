"""Every registered query against its SQL twin."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, SQL = entry.core_queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = [
        tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows
    ]
    return sorted(clean, key=str)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = oracle.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    found, expected = canonical(df.columns, df.collect()), canonical(columns, result.fetchall())
    assert found and found == expected
