"""Forward push against the dense rank: within the bound for every query and node; seeds and reasons."""

import random

import numpy as np

from vellum.operators import rank


def test_push_is_within_its_bound_of_the_dense_rank(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(150)} | {(0, i) for i in range(40)}  # a hub
    edges = {(a, b) for a, b in edges if a not in (7, 8)}  # nodes without links
    seeds = [(q, rng.randrange(40)) for q in range(6) for _ in range(3)] + [(0, 7), (9, 8), (9, 8), (10, None), (11, 99)]
    frame = spark.createDataFrame(sorted(edges) + sorted(edges)[:5] + [(None, 1)], "src long, dst long")
    got = rank.push_rank(frame, spark.createDataFrame(seeds, "query_id long, node long"), least=1e-3).collect()
    walk = np.zeros((100, 100))
    for a, b in edges:
        walk[b, a] = 1 / sum(x == a for x, _ in edges)
    assert {r.query_id for r in got} == {0, 1, 2, 3, 4, 5, 9, 11}
    for q in {r.query_id for r in got}:
        start = np.zeros(100)
        own = {n for k, n in seeds if k == q}
        start[list(own)] = 1 / len(own)
        exact = np.linalg.solve(np.eye(100) - rank.DAMPING * walk, (1 - rank.DAMPING) * start)
        found = {r.node: r for r in got if r.query_id == q}
        bound = next(iter(found.values())).bound
        assert bound < 0.2 and {n for n in range(100) if exact[n] > bound} <= set(found)
        for n, r in found.items():
            assert -1e-12 < exact[n] - r.score <= bound + 1e-12
    top = rank.best(spark.createDataFrame([(r.query_id, r.node, r.score, r.bound) for r in got], "query_id long, node long, score double, bound double"), 2).collect()
    assert all((r.rank == 1) == (r.score == max(x.score for x in got if x.query_id == r.query_id)) for r in top if r.rank == 1)


def test_seeds_and_reasons(spark):
    queries = spark.createDataFrame([(1, "How do Plan A and Report connect?"), (2, "The plan alone"), (3, "reporting"), (4, None)], "query_id long, query string")
    stems = spark.createDataFrame([("plan a",), ("plan",), ("Report",)], "node string")
    seeds = rank.seeds_of(queries, stems)
    assert sorted(tuple(r) for r in seeds.collect()) == [(1, "Report"), (1, "plan"), (1, "plan a"), (2, "plan")]
    why = {r.query_id: (r.n_seeds, r.reason) for r in rank.skip_reasons(queries, seeds).collect()}
    assert why == {1: (3, None), 2: (1, rank.ONE_SEED), 3: (0, rank.NO_SEED), 4: (0, rank.NO_SEED)}
    assert rank.push_rank(spark.createDataFrame([], "src string, dst string"), seeds.limit(0)).count() == 0


def test_push_goes_on_until_the_bound_is_met(spark):
    edges = spark.createDataFrame([(a, b) for a in range(60) for b in range(60) if a != b], "src long, dst long")
    seeds = spark.createDataFrame([(1, 0), (1, 1)], "query_id long, node long")
    loose = rank.push_rank(edges, seeds, least=1e-2).first().bound
    assert loose > 1e-3 >= rank.push_rank(edges, seeds, least=1e-2, within=1e-3).first().bound
