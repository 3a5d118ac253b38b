"""The pipeline against a brute-force version of every stage's decisions."""

import numpy as np

import corpus_pipeline
from llm_help import contaminated, near_components
from vellum.llm import pieces, quality
from vellum.llm.scratch import documents, materialize


def test_stages(spark, tiny):
    docs = documents(spark, tiny)
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    steps = dict(corpus_pipeline.STAGES)
    now = materialize(steps["quality"](spark, docs, tiny), "test-quality")
    rows = {i: t for i, t in rows.items() if quality.score(model, np.frombuffer(t.encode(), np.uint8)) >= 0.3}
    assert {r.doc_id for r in now.collect()} == set(rows)
    assert now.columns == docs.columns

    now = materialize(steps["exact_dedup"](spark, now, tiny), "test-exact")
    last = {}
    for i, t in rows.items():
        last[t] = max(i, last.get(t, -1))
    rows = {i: t for i, t in rows.items() if last[t] == i}
    assert {r.doc_id for r in now.collect()} == set(rows)

    now = materialize(steps["near_dedup"](spark, now, tiny), "test-near")
    root = near_components(rows, 5, 80)
    rows = {i: t for i, t in rows.items() if root[i] == i}
    assert {r.doc_id for r in now.collect()} == set(rows)

    now = materialize(steps["decontamination"](spark, now, tiny), "test-clean")
    bench = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not contaminated(t, bench)}
    assert {r.doc_id for r in now.collect()} == set(rows)
    assert now.columns == docs.columns

    out = steps["sentencepiece"](spark, now, tiny).collect()
    assert {r.doc_id for r in out} == set(rows)
    vocabulary = pieces.Vocabulary()
    for r in out:
        for s in r.samples:
            assert pieces.decode(np.array(s.ids, np.int32), vocabulary).decode() == rows[r.doc_id]
    assert {r.doc_id for r in corpus_pipeline.run(spark, tiny).select("doc_id").collect()} == set(rows)
