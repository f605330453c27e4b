"""Every catalog query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

from codeaudit.oracle import ORACLE
from codeaudit.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    expected = duck.execute(ORACLE[name])
    columns = [c[0] for c in expected.description]
    assert sorted(result.columns) == sorted(columns)
    got = sorted((tuple(r) for r in result.select(*columns).collect()), key=str)
    assert got == sorted(expected.fetchall(), key=str)
