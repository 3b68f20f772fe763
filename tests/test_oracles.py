"""Every named query against its DuckDB statement, row by row and value by value."""

import math
from pathlib import Path

import duckdb
import pytest

from stayline.plans import oracle, registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
SF_DIR = Path("/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(([normal(row[i]) for i in order] for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_matches_sql(spark, duck, name):
    frame = registry.queries()[name](spark, str(SF_DIR))
    spark_names, spark_rows = table(frame.columns, [tuple(row) for row in frame.collect()])
    result = duck.execute(oracle.statements()[name])
    duck_names, duck_rows = table([column[0] for column in result.description], result.fetchall())
    assert spark_names == duck_names
    assert len(spark_rows) == len(duck_rows) > 0
    for ours, theirs in zip(spark_rows, duck_rows):
        assert [type(v) for v in ours] == [type(v) for v in theirs]
        assert ours == theirs


def test_every_statement_has_a_query():
    assert set(oracle.statements()) <= set(registry.QUERIES)
