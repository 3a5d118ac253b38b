"""Pairs of vectors: these travel as they are stored and rarely, and a part is scored some rows at a time."""

import numpy as np

from vellum.operators import retrieval


def test_vectors_travel_as_stored_and_a_part_is_scored_by_rows(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 4)).astype(np.float32)
    v[::7] = v[0]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    found = retrieval.similar_pairs(rows, 0.9)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "array<double>" not in plan and retrieval.PART >= 8000 > 700 > retrieval.ROWS
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    want = {(a, b) for a, b in zip(*map(list, np.nonzero(np.triu(score >= 0.9, 1))), strict=True)}
    assert {(r.a, r.b) for r in found.collect()} == want
