"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "conversations", "labels", "pages", "benchmark"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) and not math.isnan(value) else value


def test_registries_agree():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 20


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, database, name):
    result = queries()[name](spark, FOLDER)
    columns = sorted(result.columns)
    rows = sorted((tuple(plain(row[c]) for c in columns) for row in result.collect()), key=repr)
    assert rows
    if name in oracle_sql():
        answer = database.execute(oracle_sql()[name])
        names = [column[0] for column in answer.description]
        assert sorted(names) == columns
        places = [names.index(c) for c in columns]
        assert rows == sorted((tuple(plain(row[i]) for i in places) for row in answer.fetchall()), key=repr)
