"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rowmark.plans.catalogue import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(row[i] for i in order) for row in rows]
    return sorted(cells, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert name == "file_fingerprint"
        return
    expected = duck.execute(sql)
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(df.columns)
    assert comparable(df.columns, rows) == comparable(names, expected.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["row_index", "row_id", "key_fields", "row_hash"] and df.count() == 121


def test_every_expectation_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
