"""Operators that read whole texts in Python bound the bytes of a batch, whatever ran in the session before."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import entities, html, retrieval
from vellum.sources import extract

SIZE, ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"


def _entities(spark):
    return entities.exact_matches(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("x", "a")], "entity_id string, surface string"))


def _notes(spark):
    return extract.notes(spark.createDataFrame([("a.md", "x")], "name string, text string"), F.create_map(F.lit("title"), F.lit("t")))


def _markdown(spark):
    return spark.createDataFrame([("<p>x</p>",)], "html string").select(html.to_markdown("html"))


def _nearest(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    return retrieval.top_k(rows, rows, 1)


@pytest.mark.parametrize("operator", [_entities, _notes, _markdown, _nearest])
def test_batches_are_bounded(spark, operator):
    before = spark.conf.get(SIZE), spark.conf.get(ROWS)
    try:
        spark.conf.set(SIZE, str(1 << 30))
        spark.conf.set(ROWS, "10000")
        assert operator(spark).count() > 0
        assert int(spark.conf.get(SIZE)) <= 4 << 20 and int(spark.conf.get(ROWS)) <= 2000
    finally:
        spark.conf.set(SIZE, before[0])
        spark.conf.set(ROWS, before[1])
