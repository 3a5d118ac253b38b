"""Operators that SQL can express, against DuckDB at sf0.01."""

import duckdb
import pytest

from vellum.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    found = con.execute(SQL[name])
    names = [c[0] for c in found.description]
    got = registry.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(found.fetchall(), key=str)
