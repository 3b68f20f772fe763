"""Queries against their DuckDB statements on whole tables."""

from pathlib import Path

import duckdb
import pytest

from stayline.llm import oracle, queries

SF_DIR = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle.STATEMENTS))
def test_matches_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, str(SF_DIR))
    columns = sorted(frame.columns)
    found = sorted((tuple(row) for row in frame.select(columns).collect()), key=repr)
    expected = duck.sql(oracle.STATEMENTS[name])
    assert sorted(expected.columns) == columns
    expected = sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({oracle.STATEMENTS[name]})").fetchall(), key=repr)
    assert len(found) > 0
    assert found == expected
