"""Queries with SQL give DuckDB's rows."""

import duckdb
import pytest

from factloom.llm import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        connection.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    found = queries.queries()[name](spark, FOLDER)
    wanted = connection.sql(queries.oracle_sql()[name])
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    places = [wanted.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted((tuple(r[i] for i in places) for r in wanted.fetchall()), key=repr)
