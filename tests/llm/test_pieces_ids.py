"""The query of sampled segmentations gives the ids themselves, from which every text is got back."""

import hashlib

import numpy as np

from vellum.llm import pieces


def test_ids_come_out_and_give_the_text_back(spark):
    texts = {1: "the cat sat on the mat", 2: "", 3: None, 4: "naïve ▁ café \n 中文 x", 5: "a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    vocabulary = pieces.Vocabulary()
    for r in pieces.encoded(docs).collect():
        assert len(r.ids) == r.n_samples and [len(ids) // 4 for ids in r.ids] == r.n_pieces
        for ids, digest in zip(r.ids, r.ids_sha256, strict=True):
            found = np.frombuffer(bytes(ids), "<i4")
            assert hashlib.sha256(bytes(ids)).hexdigest() == digest
            assert pieces.decode(found, vocabulary).decode() == (texts[r.doc_id] or "")
