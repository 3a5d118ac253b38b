"""N-grams over document boundaries: ranges shorter than an n-gram pass on what came before them."""

import random
from collections import Counter

import pytest

from vellum.operators import textstats


@pytest.mark.parametrize("n,per_part", [(2, 1), (4, 1), (5, 7)])
def test_equal_to_one_joined_text(spark, n, per_part):
    rng = random.Random(n)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef!", "the"]) for _ in range(rng.choice([0, 1, 1, 2, 9])))) for i in range(40)] + [(40, None), (41, "?!")]
    shuffled = rng.sample(rows, len(rows))
    docs = spark.createDataFrame([(t, i, "x") for i, t in shuffled], "text string, doc_id long, part string")
    words = " ".join(t or "" for _, t in rows).replace("!", " ").replace("?", " ").split()
    whole = Counter(tuple(words[j : j + n]) for j in range(len(words) - n + 1))
    inside = Counter(tuple(w[j : j + n]) for _, t in rows for w in [(t or "").replace("!", " ").replace("?", " ").split()] for j in range(len(w) - n + 1))
    got = Counter()
    for r in textstats.across_documents(docs, n, "doc_id", per_part=per_part).collect():
        got.update(tuple(r.t[j : j + n]) for j in range(len(r.t) - n + 1))
    assert got == whole - inside and sum(got.values()) == sum(whole.values()) - sum(inside.values())
    assert textstats.across_documents(docs.limit(0), n, "doc_id").count() == 0


@pytest.mark.parametrize("across", [None, "doc_id"])
@pytest.mark.parametrize("first", [1, 3, 1000])
def test_every_bin_that_may_matter_is_counted(spark, across, first):
    """Flat counts with many ties, so that the fullest bins are not enough."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "the", "OF", "e-f", "\u212a9"]) for _ in range(rng.choice([0, 1, 3, 40])))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stop = {"the", "of"}
    lists = [(t or "").lower().replace("-", " ").split() for _, t in rows]
    if across:
        lists = [[w for t in lists for w in t]]
    want = Counter(" ".join(w[j : j + 3]) for w in lists for j in range(len(w) - 2) if not stop.issuperset(w[j : j + 3]))
    want = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert [(r.ngram, r.n) for r in textstats.ngrams(docs, 3, 20, across=across, first=first).collect()] == want
    assert textstats.ngrams(docs.limit(0), 3, 20, across=across, first=first).count() == 0


def test_no_row_for_each_place(spark):
    """A row for each n-gram's place once went through Spark; now one for a bin and task."""
    docs = spark.createDataFrame([(i, "one two three four five six " * 300) for i in range(8)], "doc_id long, text string")
    counts = docs.select(textstats._plain("text").alias("plain")).coalesce(2).mapInArrow(textstats._bin_counts(3), "bin long, n long")
    assert counts.count() <= 12 and counts.agg({"n": "sum"}).first()[0] == 8 * 1798
