"""Clustering of vectors around centroids in whole numbers, with block-norm screening.

Vectors become whole numbers once. Each is compressed to the norms of its segments; by the
inequality of Cauchy and Schwarz, a segment's distance is at least the difference of the two
norms, so the summed squares of these differences bound a distance from below. The centroid
of the least bound is measured first; of the others, only those whose bound does not exceed
the least distance so far are measured, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.scratch import lean, materialize, small_batches

CLUSTERS, ROUNDS, DIMS, SEGMENTS, SCALE = 8, 10, 64, 8, 1024
#: Before the id, what the first centroids are chosen by.
SEED = "3:"
#: Whole components are held within this, so that a squared distance fits a long.
MOST = (1 << 27) - 1


def _norms(x: np.ndarray, segments: int) -> np.ndarray:
    """Norm of each segment of each row."""
    at = np.linspace(0, x.shape[1], segments + 1).astype(int)[:-1]
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, at, axis=1))


def bounds(norms: np.ndarray, centroid_norms: np.ndarray) -> np.ndarray:
    """For each vector and centroid, what their squared distance is not below; short of it by more than rounding may err."""
    gap = np.abs(norms[:, None, :] - centroid_norms[None, :, :]) - 1e-12 * (norms[:, None, :] + centroid_norms[None, :, :])
    return (np.maximum(gap, 0) ** 2).sum(axis=2) * (1 - 1e-12)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (of equal ones the first), the squared distance, and how many distances were measured."""
    low = bounds(norms, _norms(centroids, segments))
    best = low.argmin(axis=1)
    distance = ((x - centroids[best]) ** 2).sum(axis=1)
    measured = len(x)
    for j, centroid in enumerate(centroids):
        rows = np.flatnonzero((low[:, j] <= distance) & (best != j))
        if len(rows):
            found = ((x[rows] - centroid) ** 2).sum(axis=1)
            closer = (found < distance[rows]) | ((found == distance[rows]) & (j < best[rows]))
            best[rows[closer]], distance[rows[closer]] = j, found[closer]
            measured += len(rows)
    return best, distance, measured


def _compress(dims: int, segments: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vec_id, embedding) -> whole components and segment norms, as bytes."""
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            x = np.clip(np.floor(values * scale), -MOST, MOST).astype("<i4")
            fixed = lambda a: pa.FixedSizeBinaryArray.from_buffers(pa.binary(a.shape[1] * a.itemsize), len(a), [None, pa.py_buffer(a.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), fixed(x), fixed(_norms(x, segments))], names=["vec_id", "x", "norms"])

    return run


def _read(batch: pa.RecordBatch, name: str, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist()), kind).reshape(-1, width)


def _sums(centroids: np.ndarray, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sum of each component and count of rows for each of its clusters."""
        k, dims = centroids.shape
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _read(batch, "x", "<i4", dims).astype(np.int64)
            best, _, _ = nearest(x, _read(batch, "norms", "<f8", segments), centroids, segments)
            for j in np.unique(best):
                total[j] += x[best == j].sum(axis=0)
            n += np.bincount(best, minlength=k)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(own)), pa.int32()), pa.array(total[own].ravel()), pa.array(np.repeat(n[own], dims))], names=["cluster", "part", "total", "n"])

    return run


def _assign(centroids: np.ndarray, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _read(batch, "x", "<i4", centroids.shape[1]).astype(np.int64)
            best, distance, _ = nearest(x, _read(batch, "norms", "<f8", segments), centroids, segments)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, segments: int = SEGMENTS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """One row for every kept row of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid (whole components).

    Kept are vectors of ``dims`` components, none null, NaN or infinite; others have no
    row, and a null vector none either. The first centroids are the ``k`` vectors of
    least SHA-256 of ``seed`` and vec_id (nothing for a null one), of equal ones those
    of lesser components; of fewer vectors all. Equal rows are vectors of their own. A centroid
    that no vector is nearest to stays as it is. Whole components beyond 2**27 - 1
    in magnitude are held there; an inertia that a long can't hold is null. Other
    columns are ignored; an empty table gives an empty result.

    The compressed table is written once; each round reads it and shuffles no vector: a
    task sends one sum for each component and cluster, and only their totals, ``k`` rows
    of ``dims`` numbers, come to the driver.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    good = F.coalesce(F.size("embedding") == dims, F.lit(False)) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    table = materialize(vectors.where(good).select("vec_id", "embedding").mapInArrow(lean(_compress(dims, segments, scale)), f"vec_id {id_type}, x binary, norms binary"), "vectors")
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))))
    start = vectors.where(good).select(key.alias("key"), whole.alias("x")).orderBy("key", "x").limit(k).collect()
    if not start:
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>")
    centroids = np.array([r.x for r in start], np.int64)
    for _ in range(rounds):
        found = table.mapInArrow(lean(_sums(centroids, segments)), "cluster int, part int, total long, n long")
        for r in found.groupBy("cluster", "part").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            centroids[r["cluster"], r["part"]] = r["total"] // r["n"]
    assigned = materialize(table.mapInArrow(lean(_assign(centroids, segments)), f"vec_id {id_type}, cluster int, distance long"), "assigned")
    # a row for each cluster
    own = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = {r["cluster"]: int(r["own"]) for r in own.collect()}
    fits = lambda n: n if n < 1 << 63 else None
    said = spark.createDataFrame([(j, fits(n), fits(sum(total.values())), centroids[j].tolist()) for j, n in total.items()], "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    return assigned.join(F.broadcast(said), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"))


def sql(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> str:
    """The same in SQL, a pair of tables for each round."""
    near = "SELECT id, vec_id, q, min(({d}, no)) AS best FROM (SELECT id, vec_id, v.q, c.no, list_sum(list_transform(range(1, {dims} + 1), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT AS d FROM v, c{r} c) GROUP BY id, vec_id, q"
    near = near.replace("min(({d}, no))", "min(struct_pack(d := d, no := no))").replace("{dims}", str(dims))
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key, q) - 1 AS no, q FROM (SELECT sha256('{SEED}' || coalesce(vec_id::VARCHAR, '')) AS key, q FROM v) ORDER BY key, q LIMIT {k})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.replace('{r}', str(r))})")
        mean = "(s - (s % n + n) % n) // n"
        parts.append(f"m{r} AS (SELECT no, list(({mean})::BIGINT ORDER BY j) AS q FROM (SELECT no, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT best.no AS no, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{r}) GROUP BY no, j) GROUP BY no)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.no, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m ON m.no = c.no)")
    parts.append(f"z AS ({near.replace('{r}', str(rounds))})")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, best.no::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.no))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM z JOIN c{rounds} c ON c.no = best.no"""
