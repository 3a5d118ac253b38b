"""Entity links: every whole-word match against a plain search, overlaps, caps and other recognisers."""

import random
import re

import numpy as np
import pytest

from vellum.operators import entities


@pytest.mark.parametrize("stretch", [4, 2048])
def test_automaton_finds_every_occurrence(monkeypatch, stretch):
    monkeypatch.setattr(entities, "STRETCH", stretch)
    rng = random.Random(stretch)
    for _ in range(80):
        names = list({"".join(rng.choice("ab é") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 10))})
        texts = ["".join(rng.choice("ab é") for _ in range(rng.randrange(60))).encode() for _ in range(5)]
        automaton = entities.Automaton([n.encode() for n in names])
        at = np.cumsum([0] + [len(t) for t in texts])
        text, end, surface = automaton.find(np.frombuffer(b"".join(texts), np.uint8), at)
        got = sorted((int(t), int(e - at[t]), names[s]) for t, e, s in zip(text, end, surface))
        assert got == sorted((i, j + len(n.encode()), n) for i, t in enumerate(texts) for n in names for j in range(len(t)) if t.startswith(n.encode(), j))


def plain(texts, known):
    out = []
    for i, text in texts:
        for entity, name in known:
            if name and (m := re.search(rf"(?<!\w)(?={re.escape(name)}(?!\w))", text or "")):
                out.append((i, entity, name, m.start(), m.start() + len(name)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [5, 1 << 17])
def test_matches_equal_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(entities, "BLOCK_BYTES", block)
    rng = random.Random(4)
    words = ["start", "art", "gallery", "galleryx", "été", "éta", "a", "C++", "日本", "ART"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(40)] + [(None, "art"), (7, "art"), (50, None), (51, "")]
    known = [(f"10 People/{n}", n) for n in ("art", "art gallery", "gallery", "été", "a", "C++", "日本", "no such")] + [("x", "art"), ("y", ""), ("z", None)]
    docs, catalogue = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, matched string"), spark.createDataFrame(known + known[:2], "entity_id string, surface string")
    got = [tuple(r) for r in entities.exact_matches(docs, catalogue).collect()]
    # one row for each text, also of texts that share an id
    assert sorted(got, key=str) == plain(texts, known)


def test_inner_words_do_not_match(spark):
    docs = spark.createDataFrame([(1, "start art"), (2, "the art galleryx")], "doc_id long, text string")
    found = entities.link_candidates(docs, spark.createDataFrame([("10 Arts/art", "art"), ("art gallery", "art gallery")], "entity_id string, surface string"))
    assert sorted((r.doc_id, r.entity_id, r.start, r.end, r.wikilink) for r in found.collect()) == [(1, "10 Arts/art", 6, 9, "[[art]]"), (2, "10 Arts/art", 4, 7, "[[art]]")]


def test_anywhere_in_the_text(spark):
    docs = spark.createDataFrame([(1, "start art"), (2, "été"), (3, None)], "doc_id long, text string")
    found = entities.exact_matches(docs, spark.createDataFrame([(7, "art"), (8, "té")], "entity_id long, surface string"), whole=False)
    assert sorted((r.key, r.entity_id, r.start, r.end) for r in found.collect()) == [(1, 7, 2, 5), (2, 8, 1, 3)]


def test_cap_and_other_recognisers(spark):
    names = [f"name{i:02d}" for i in range(60)]
    docs = spark.createDataFrame([(1, "Ada Lovelace met " + " ".join(names)), (2, "Ada Lovelace met name01")], "doc_id long, text string")
    catalogue = spark.createDataFrame([(n, n) for n in names], "entity_id string, surface string")
    others = spark.createDataFrame([(i, f"ner/{m}", m, "ner", a, b) for i in (1, 2) for m, a, b in (("Ada Lovelace", 0, 12), ("name01", 17, 23))], "doc_id long, entity_id string, matched string, confidence string, start long, end long")
    got = entities.link_candidates(docs, catalogue, others=others).collect()
    one = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.start)
    assert [r.matched for r in one] == names[:50] and {r.truncated for r in one} == {11}
    assert sorted((r.matched, r.confidence, r.truncated) for r in got if r.doc_id == 2) == [("Ada Lovelace", "ner", 0), ("name01", "exact", 0)]
    assert entities.link_candidates(docs, catalogue.limit(0)).count() == 0
