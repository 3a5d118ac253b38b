"""Scores in an advisory table are rounded as numbers, not as their shortest decimals."""

import duckdb

from vellum.operators import reports

SCORES = [0.99385, 0.99365, 0.84375, 0.12345, 0.40005, 0.50015, 0.62505, 1.0]


def test_scores_are_rounded_as_sql_does(spark):
    rows = spark.createDataFrame([(i, 7, s) for i, s in enumerate(SCORES)], "key long, other long, score double")
    got = {r.key: r.block for r in reports.soft_duplicate_blocks(rows, -1).collect()}
    for i, s in enumerate(SCORES):
        said = duckdb.execute("SELECT format('{:.4f}', ?::DOUBLE)", [s]).fetchone()[0]
        assert f"**Top semantic score:** {said}\n" in got[i]
        assert got[i].endswith(f"| {said} | `7` |")
