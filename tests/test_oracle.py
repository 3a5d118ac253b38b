"""Every query with SQL is held against DuckDB at sf0.01."""

import duckdb
import pytest

from vellum.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(SQL[name])
    want = _rows([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "a query without rows checks nothing"


def test_queries_without_sql(spark, small):
    pairs = catalog.queries()["pairs_greedy_cap"](spark, small).collect()
    seen = {}
    for r in sorted(pairs, key=lambda r: (-r.score, r.a, r.b)):
        assert r.score >= 0.3
        for side in (r.a, r.b):
            seen[side] = seen.get(side, 0) + 1
    assert max(seen.values()) <= 5
    assert catalog.queries()["html_to_markdown"](spark, small).where("markdown is null or markdown = ''").count() == 0
