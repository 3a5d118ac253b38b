"""Heads of chains of every length, and how much the rounds write."""

import random

import pytest

from vellum.operators import graph


@pytest.fixture
def chains():
    """(key, before) of chains of 1 to 40 versions; one version's predecessor is not there."""
    keys = random.Random(3).sample(range(10_000), 820)
    rows, want = [], []
    for n in range(1, 41):
        own, keys = keys[:n], keys[n:]
        rows += zip(own, [-1 if n == 7 else None, *own], strict=False)
        want += [(k, own[-1], n - 1 - i) for i, k in enumerate(own)]
    random.Random(4).shuffle(rows)
    return rows, sorted(want)


def test_each_round_takes_what_is_left(spark, chains, monkeypatch):
    rows, want = chains
    tables, plain = [], graph.materialize

    def counted(df, tag):
        tables.append(plain(df, tag))
        return tables[-1]

    monkeypatch.setattr(graph, "materialize", counted)
    found = graph.chain_heads(spark.createDataFrame(rows, "id long, old long"), "id", "old")
    assert sorted(map(tuple, found.collect())) == want and found.columns == ["node", "head", "length"]
    sizes = [t.count() for t in tables]
    # versions with a successor, then those 2, 4, 8, ... or more links from the head
    assert sizes == [len(want), *[sum(x[2] >= d for x in want) for d in (1, 2, 4, 8, 16, 32)]]
    none = graph.chain_heads(spark.createDataFrame([], "id long, old long"), "id", "old")
    assert none.count() == 0
