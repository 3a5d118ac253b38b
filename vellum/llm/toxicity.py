"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed character n-grams of lower-cased letters. Each
is scaled by the log ratio of its share of toxic and of other texts; a logistic
regression on the scaled features gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.learning import code_parts, folded_parts, gram_parts, labelled, remainder, segments, sigmoid, sum_segments
from vellum.llm.scratch import documents, lean, materialize, small_batches
from vellum.llm.textbytes import raw

BUCKETS = 1 << 20
ORDERS = (3, 4, 5, 6)
#: Labelled texts that the model is fitted on.
SAMPLE = 20_000
#: Least G-test value of a feature: one n-gram in six hundred reaches it without a tie to the class. Of 3.84, 10, 15 and 29.7 the one with the best recall and precision.
STRENGTH = 10.0
#: Rows that the fit meets at a time.
BLOCK = 512


@dataclass
class Model:
    weights: np.ndarray  # by bucket, the ratio times the learned weight; 0: not a feature
    bias: float


def present(data: np.ndarray, keep: np.ndarray | None = None, step: int | None = None) -> np.ndarray:
    """Distinct buckets of a text, or of them those where ``keep`` is not 0; ``step`` bytes are met at a time, which changes nothing."""
    found = np.zeros(0, np.int64)
    parts = folded_parts(code_parts(data, step))
    held, size = [], 0
    for g in gram_parts(parts, ORDERS, BUCKETS):
        held.append(g if keep is None else g[keep[g] != 0])
        size += len(held[-1])
        if size > 2 * BUCKETS:  # a text's distinct buckets are BUCKETS at most
            found, held, size = np.unique(np.concatenate((found, *held))), [], 0
    return np.unique(np.concatenate((found, *held)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A table of the texts with each bucket: the other texts first, then the toxic ones."""
    total = np.zeros(2 * BUCKETS, np.int64)
    for batch in batches:
        data, at = raw(batch.column(0))
        for i, label in enumerate(batch.column(1).to_pylist()):
            total[present(data[at[i] : at[i + 1]]) + BUCKETS * label] += 1
    parts = list(segments(total))
    for i in range(0, len(parts), 64):
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts[i : i + 64]], pa.int32()), pa.array([b for _, b in parts[i : i + 64]], pa.binary())], names=["segment", "counts"])


def log_likelihood(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """How strongly a feature's presence depends on the class (G-test)."""
    total = n_pos + n_neg
    out = np.zeros(len(pos))
    for seen, n in ((pos, n_pos), (neg, n_neg)):
        for has, all_of in ((seen, pos + neg), (n - seen, total - pos - neg)):
            expected = all_of * (n / total)
            out += np.where(has > 0, has * np.log(np.maximum(has, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    return 2 * out


def fit(rows: DataFrame, strength: float = STRENGTH) -> Model:
    """Fit on ``rows`` (text, label), which the caller bounds. Rows with a label other than 0 and 1 are passed over; without both the score is the share of label 1.

    Every n-gram whose presence depends on the class beyond chance is a feature.
    """
    small_batches(rows.sparkSession)
    rows = materialize(rows.select("text", "label").where(F.col("label").isin(0, 1)), "toxicity-sample")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((n_pos + 0.1) / (n_neg + 1))))
    table = sum_segments(rows.mapInArrow(lean(_count), "segment int, counts binary"), 2 * BUCKETS)
    neg, pos = table[:BUCKETS], table[BUCKETS:]
    best = np.flatnonzero(log_likelihood(pos, neg, n_pos, n_neg) > strength)
    ratio = np.zeros(BUCKETS)
    ratio[best] = np.log((pos[best] + 1) / (n_pos + 2)) - np.log((neg[best] + 1) / (n_neg + 2))
    place = np.full(BUCKETS, -1, np.int32)
    place[best] = np.arange(len(best))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(0))
            found = [place[present(data[at[i] : at[i + 1]], ratio)].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["label", "features"])

    sample = rows.mapInArrow(lean(held), "label int, features binary").toPandas().sort_values(["label", "features"])
    if not len(best):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(n_pos / n_neg)))
    sizes, y = sample.features.map(len).to_numpy(np.int64) // 4, sample.label.to_numpy(float)
    col = np.frombuffer(b"".join(sample.features), np.int32)
    del sample, table, pos, neg, place  # the driver's memory
    weight, bias = regress(col, sizes, y, ratio[best])
    out = np.zeros(BUCKETS, np.float32)
    out[best] = weight * ratio[best]
    return Model(out, bias)


def regress(col: np.ndarray, sizes: np.ndarray, y: np.ndarray, scale: np.ndarray, ridge: float = 3e-3, rounds: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression on rows of scaled indicators, by full gradient steps of adaptive size that shrink over the rounds. ``sizes``: how many of ``col`` each row has."""
    n, d = len(y), len(scale)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    edges = ends[np.minimum(np.arange(0, n + BLOCK, BLOCK), n)]  # rows are met in blocks, for the driver's memory
    w = np.zeros(d + 1)
    w[d] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    first, second = np.zeros(d + 1), np.zeros(d + 1)
    for i in range(1, rounds + 1):
        scaled, slope = w[:d] * scale, np.zeros(d + 1)
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            own = slice(k * BLOCK, min(n, (k + 1) * BLOCK))
            at = np.repeat(np.arange(own.stop - own.start, dtype=np.int32), sizes[own])
            g = (sigmoid(np.bincount(at, scaled[col[a:b]], own.stop - own.start) + w[d]) - y[own]) / n
            slope[:d] += np.bincount(col[a:b], g[at], d)
            slope[d] += g.sum()
        slope[:d] = slope[:d] * scale + ridge * w[:d]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        w -= rate * (1 - i / (rounds + 1)) * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-10)
    return w[:d], float(w[d])


def predict(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row; null and empty texts get the score of a text without features.

    Whole texts are read, a bounded stretch at a time, with the n-grams across its
    ends. Repeated rows and equal texts get equal scores. An empty table gives an
    empty result. Other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(1))
            score = [float(sigmoid(model.weights[present(data[at[i] : at[i + 1]], model.weights)].astype(np.float64).sum() + model.bias)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {id_type}, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", 4, 2, SAMPLE))
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
