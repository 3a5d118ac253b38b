"""Keys of six digits, as larger tables have them, against SQL."""

import duckdb
import pytest

from vellum.plans import catalog

#: Tables with the keys that are shifted in them.
SHIFTED = {"part": ["p_partkey"], "lineitem": ["l_partkey"], "orders": ["o_custkey"], "customer": ["c_custkey"], "events": ["user_id"]}


@pytest.fixture(scope="module")
def large_keys(tiny, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("large-keys"))
    for name, keys in SHIFTED.items():
        shifted = ", ".join(f"{k} + 150000 AS {k}" for k in keys)
        duckdb.sql(f"COPY (SELECT * REPLACE ({shifted}) FROM '{tiny}/{name}.parquet') TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["orphan_notes", "orphan_reach", "version_reach_strict", "stale_a3", "stale_rules", "stale_rollup"])
def test_keys_are_no_dates(spark, large_keys, name):
    con = duckdb.connect()
    for t in SHIFTED:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{large_keys}/{t}.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    got = sorted(str(tuple(r)) for r in catalog.queries()[name](spark, large_keys).select(*names).collect())
    assert got == want and got
