"""Rows that share a doc_id, clashing columns, nulls, empty tables and long texts, for the stages that drop rows."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from vellum.llm import decontaminate, exactdedup, jaccardjoin, linededup, quality, scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["at", "of", "dropped_id", "decided_id", "decided_text", "own_text", "kept", "keep", "node", "token", "score", "block", "owner", "text_key", "bits"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def clashing(docs):
    return docs.select("*", *[F.lit(c).alias(c) for c in CLASH])


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


A = "one two three four five six seven eight nine ten"
B = "entirely other words stand in this row of the table here"


def test_near_copies_are_told_by_row(spark):
    got = jaccardjoin.drop_near_copies(clashing(frame(spark, [(1, A), (2, B), (2, A)])))
    assert rows(got) == rows(frame(spark, [(1, A), (2, B)]))
    assert got.columns[5:] == CLASH
    # equal rows, equal sets of one doc_id, rows without a doc_id, blank texts
    got = jaccardjoin.drop_near_copies(clashing(frame(spark, [(1, A), (1, A), (1, A.upper()), (None, A), (3, ""), (3, ""), (3, None), (3, " "), (None, B), (None, B)])))
    kept = got.collect()
    assert len(kept) == 6 and sum((r.text or "").lower() == A for r in kept) == 1
    assert [(r.doc_id, r.text) for r in kept if r.text == B] == [(None, B)]
    assert jaccardjoin.drop_near_copies(clashing(frame(spark, []))).count() == 0


def test_copies_with_clashing_columns(spark):
    docs = clashing(frame(spark, [(1, A), (2, A), (2, A), (2, B), (None, A), (None, None), (4, ""), (5, None)]))
    got = exactdedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert rows(got) == rows(frame(spark, [(2, A), (2, B), (5, None)]))
    assert exactdedup.drop_copies(docs.limit(0)).count() == 0


def test_many_rows_without_a_doc_id(spark):
    docs = frame(spark, [(None, f"text number {i % 50} of these") for i in range(300)])
    assert exactdedup.drop_copies(docs).count() == 50
    assert {r.group_size for r in exactdedup.dedup(docs).collect()} == {6}


@pytest.mark.parametrize("huge", [1000, 1 << 24])
def test_huge_copies_meet_by_chunks(spark, huge, monkeypatch):
    monkeypatch.setattr(exactdedup, "CHUNK", 256)
    monkeypatch.setattr(exactdedup, "_POWERS", [])
    text = "é line of a long text\n" * 400
    docs = frame(spark, [(1, text), (2, text), (3, text[:-2] + "x\n"), (4, text), (5, "short"), (6, "short")])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdedup.dedup(docs, huge).collect()}
    assert got == {1: (4, 3, False), 2: (4, 3, False), 3: (3, 1, True), 4: (4, 3, True), 5: (6, 2, False), 6: (6, 2, True)}


def test_huge_texts_of_colliding_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "CHUNK", 256)
    monkeypatch.setattr(exactdedup, "_POWERS", [])
    text = "a long line of text\n" * 100
    docs = frame(spark, [(1, text), (2, text[:-2] + "x\n"), (3, text)])
    real = exactdedup.fingerprints
    monkeypatch.setattr(exactdedup, "fingerprints", lambda *a, **b: real(*a, **b).withColumn("fingerprint", F.lit(7).cast("long")))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdedup.dedup(docs, 1000).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}


@pytest.mark.parametrize("huge", [1000, 1 << 24])
def test_colliding_texts_of_one_doc_id(spark, huge, monkeypatch):
    monkeypatch.setattr(exactdedup, "CHUNK", 256)
    monkeypatch.setattr(exactdedup, "_POWERS", [])
    real = exactdedup.fingerprints
    monkeypatch.setattr(exactdedup, "fingerprints", lambda *a, **b: real(*a, **b).withColumn("fingerprint", F.lit(7).cast("long")))
    for a, b in (("aa", "bb"), ("a" * 2000, "a" * 1999 + "b")):
        docs = frame(spark, [(7, a), (7, b), (6, b), (None, a), (None, b)])
        got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdedup.dedup(docs, huge).collect()), key=str)
        assert got == sorted([(7, 7, 2, True), (7, 7, 3, True), (6, 7, 3, False), (None, 7, 2, False), (None, 7, 3, False)], key=str)
        assert rows(exactdedup.drop_copies(docs)) == rows(frame(spark, [(7, a), (7, b)]))
    docs = frame(spark, [(7, "aa"), (7, "bb")])
    assert {(r.group_size, r.kept) for r in exactdedup.dedup(docs, huge).collect()} == {(1, True)}
    assert exactdedup.drop_copies(docs).count() == 2


def test_lines_of_rows_that_share_a_doc_id(spark):
    p, other = "a first line\na second line\nend é", "é\u00fc own\nquite other\nlines"
    got = linededup.dedup_lines(clashing(frame(spark, [(1, p), (2, p), (2, other), (2, other), (None, p)]))).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, p), (1, ""), (2, ""), (2, other), (2, other)], key=str)


def test_filters_with_clashing_columns(spark):
    docs = clashing(frame(spark, [(1, A), (1, A), (2, None), (3, ""), (None, B), (4, "x " + A + " y")]))
    bench = spark.createDataFrame([(1, A), (2, None)], "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench)
    assert got.columns == docs.columns and rows(got) == rows(frame(spark, [(2, None), (3, ""), (None, B)]))
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 6 and decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    model = quality.Model([0.0] * quality.DIMS, 0.0, 0.5)
    assert quality.keep_good(docs, model).count() == 6 and quality.keep_good(docs.limit(0), model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns


def test_all_stages_on_odd_rows(spark, tiny):
    long = " ".join(f"w{i}" for i in range(30000))
    docs = frame(spark, [(1, A), (1, A), (2, None), (3, ""), (None, B), (None, B), (4, long), (5, long), (2, B + " more")])
    for source in (clashing(docs), clashing(docs).limit(0)):
        now = source
        for name, stage in corpus_pipeline.STAGES:
            before = now
            now = scratch.materialize(stage(spark, now, tiny), f"odd-{name}")
            if name != "sentencepiece":
                assert now.columns == before.columns
                assert not now.exceptAll(before).count()
        if source.limit(1).count() and not now.count():
            raise AssertionError("nothing is left")


def test_no_local_folder_on_a_cluster():
    from vellum.scratch import scratch_dir

    class Session:
        def __init__(self, **conf):
            self.conf = conf

    assert scratch_dir(Session(**{"spark.checkpoint.dir": "s/", "spark.master": "yarn"})) == "s"
    with pytest.raises(ValueError):
        scratch_dir(Session(**{"spark.checkpoint.dir": None, "spark.master": "yarn"}))
