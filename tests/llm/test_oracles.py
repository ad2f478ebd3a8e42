"""Queries with SQL give the same rows in DuckDB."""

import duckdb
import pytest

from strandline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(want.fetchall()) == sorted(tuple(r[c] for c in want.columns) for r in got.collect())
