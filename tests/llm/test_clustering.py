"""Clustering: screening against all distances, bounds below distances, odd vectors."""

import hashlib
import math

import numpy as np

from vellum.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, x string, cluster string"


def plain(rows, k, rounds):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [r[1] for r in sorted(kept, key=key)[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        to = [assign(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), t in zip(kept, to) if t == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *assign(v)[::-1]) for i, v in kept]
    return sorted(((i, c, d, sum(x[2] for x in found if x[1] == c), sum(x[2] for x in found), centroids[c]) for i, c, d in found), key=str)


def test_screening_equals_all_distances():
    rng = np.random.default_rng(2)
    skipped = 0
    for trial in range(30):
        scale = rng.choice([3, 1000, clustering.MOST])
        centers = rng.integers(-scale, scale + 1, (8, 64))
        x = np.clip(centers[rng.integers(0, 8, 200)] + rng.integers(-2, 3, (200, 64)) if trial % 2 else rng.integers(-scale, scale + 1, (200, 64)), -clustering.MOST, clustering.MOST)
        c = np.concatenate([centers[:5], centers[:3]])  # ties
        norms = clustering._norms(x, 8)
        all_distances = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (clustering.bounds(norms, clustering._norms(c, 8)) <= all_distances).all()
        best, distance, measured = clustering.nearest(x, norms, c)
        assert (best == all_distances.argmin(axis=1)).all() and (distance == all_distances.min(axis=1)).all()
        skipped += all_distances.size - measured
    assert skipped


def test_clusters_equal_plain(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=64).round(3).tolist()) for i in range(60)]
    odd = [(None, vectors[0][1]), (None, vectors[1][1]), (7, vectors[7][1]), (7, vectors[8][1]), (100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [float("nan")] * 64), (106, [float("inf")] + [0.0] * 63), (107, [0.0] * 64), (108, [0.0] * 64)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in vectors + odd], SCHEMA)
    got = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in clustering.cluster(frame, rounds=3).collect()), key=str)
    assert got == plain(vectors + odd, 8, 3)


def test_few_none_and_huge(spark):
    def run(rows):
        return clustering.cluster(spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA), rounds=2).collect()

    assert run([]) == [] and run([(1, None), (2, [1.0])]) == []
    assert [(r.vec_id, r.distance) for r in run([(1, [0.5] * 64), (1, [0.5] * 64)])] == [(1, 0), (1, 0)]
    huge = run([(i, [s * 3e38] * 64) for i, s in enumerate([1, -1, 1, 0, 0.5, 1, 1, 1, 1, -1])])
    assert len(huge) == 10 and all(r.distance == 0 for r in huge)
