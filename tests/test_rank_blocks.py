"""Push of many queries side by side: rows of state, rounds, both joins; first words."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import rank

QUERIES, NODES = 20, 60


def _case(spark):
    rng = random.Random(5)
    edges = {(a, (a + 1) % NODES) for a in range(NODES)} | {(rng.randrange(NODES), rng.randrange(NODES)) for _ in range(120)} | {(3, i) for i in range(NODES)}
    edges |= {(a, 100 + a % 7) for a in range(0, NODES, 3)}  # nodes without links
    seeds = {(q, n) for q in range(QUERIES) for n in rng.sample(range(NODES), 2)} | {(0, 103), (1, 200)}
    return edges, seeds, spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame(sorted(seeds), "query_id long, node long")


def _dense(edges, seeds, query):
    walk, start = np.zeros((201, 201)), np.zeros(201)
    for a, b in edges:
        walk[b, a] = 1 / sum(x == a for x, _ in edges)
    own = [n for q, n in seeds if q == query]
    start[own] = 1 / len(own)
    return np.linalg.solve(np.eye(201) - rank.DAMPING * walk, (1 - rank.DAMPING) * start)


def _holds(got, edges, seeds, within):
    for q in range(QUERIES):
        exact, found = _dense(edges, seeds, q), {r.node: r for r in got if r.query_id == q}
        bound = {r.bound for r in found.values()}
        assert len(bound) == 1 and bound.pop() <= within and {n for n in range(201) if exact[n] > within} <= set(found)
        assert all(-1e-12 < exact[n] - r.score <= r.bound + 1e-12 for n, r in found.items())
    assert len(got) == len({(r.query_id, r.node) for r in got})


def test_queries_share_rows_and_rounds_follow_the_bound(spark, monkeypatch):
    edges, seeds, links, asked = _case(spark)
    states, write = [], rank.materialize

    def seen(df, tag):
        out = write(df, tag)
        if tag == "push-state":
            states.append(out.count())
        return out

    monkeypatch.setattr(rank, "materialize", seen)
    got = rank.push_rank(links, asked, least=1e-3, within=1e-3).collect()
    _holds(got, edges, seeds, 1e-3)
    assert max(states) <= (NODES + 2) * math.ceil(QUERIES / 8)  # not a row for each query and node
    assert len(states) <= math.ceil(math.log(1e-3) / math.log(rank.DAMPING) / rank.ROUNDS)


def test_links_that_are_shuffled_give_the_same(spark, monkeypatch):
    edges, seeds, links, asked = _case(spark)
    for name, value in (("FEW_LINKS", 0), ("FEW_ROWS", 0), ("WIDTH", 2), ("CHUNK", 4), ("NUMBERED", 3), ("ROUNDS", 2), ("MOST_ROUNDS", 3)):
        monkeypatch.setattr(rank, name, value)
    _holds(rank.push_rank(links, asked, least=1e-1, within=1e-1).collect(), edges, seeds, 1e-1)


def test_first_words_are_those_of_the_whole_text(spark):
    texts = ["", " .;", "one", "  one two\nthree-four five", "a_b 12 é́x Ωmega 日本 語", "\U0001d400\U0001d401 \U0001f600 x y z w", "x" * 30000 + " y", None, "." * 30000 + "z"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select(T.first_words(F.col("text"), 4).alias("first"), F.slice(T.words(F.col("text")), 1, 4).alias("want")).collect()
    assert all(r.first == r.want for r in got) and len(got) == len(texts)
