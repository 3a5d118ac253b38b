"""Quality by positive-unlabelled learning.

Trusted positives are texts labelled 1; the unlabelled are web texts of any kind. A
scorer on the shapes of characters and on repetition minimises the non-negative
unbiased risk: with class prior p, the risk of the negatives is that of all
unlabelled texts as negatives less p times that of the positives as negatives, and
where this estimate falls below zero its gradient is reversed, so that the scorer
cannot gain from it. The prior is estimated from a first scorer: the share of the
unlabelled above a score, against that of the positives, is least among the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.learning import code_parts, gram_parts, kinds, labelled, remainder, sampled, sigmoid
from vellum.llm.scratch import documents, filter_rows, lean, small_batches
from vellum.llm.textbytes import EXACT, LINE, classes, raw, words

BUCKETS = 1024
ORDERS = (1, 2, 3, 4)
#: Shares beyond which each of the measures of repetition counts as a feature.
STEPS = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
MEASURES = 5
DIMS = BUCKETS + MEASURES * len(STEPS) + 1
#: Trusted positives and unlabelled texts that the model is fitted on.
POSITIVES, UNLABELLED = 4000, 8000


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float


def _repeats(hashes: np.ndarray, data: np.ndarray) -> list[float]:
    n = max(1, len(hashes))
    start, end, line = words(data, LINE, EXACT)
    first = np.unique(line, return_index=True)[1]
    copied = int((end - start).sum() - (end - start)[first].sum())  # bytes of lines that occurred before
    distinct = len(np.unique(hashes))
    top = 1 - distinct / n
    return [
        float((hashes[1:] == hashes[:-1]).sum()) / n,
        float((hashes[2:] == hashes[:-2]).sum()) / n,
        copied / max(1, len(data)),
        max(0.0, top - 0.5),
        1.0 / (1 + len(hashes)),
    ]


def features(data: np.ndarray, step: int | None = None) -> np.ndarray:
    """Rates of n-grams of character kinds, on a log scale, and steps of the measures of repetition; ``step`` bytes are met at a time, which changes nothing."""
    tf = np.zeros(BUCKETS)
    for g in gram_parts(map(kinds, code_parts(data, step)), ORDERS, BUCKETS):
        tf += np.bincount(g, minlength=BUCKETS)
    size = int(np.count_nonzero((data & 0xC0) != 0x80))  # characters
    out = np.zeros(DIMS, np.float32)
    out[:BUCKETS] = np.log1p(1000 * tf / max(1, size)) / 4
    measures = _repeats(words(data, classes(True))[2], data)
    out[BUCKETS:-1] = [float(m > s) for m in measures for s in STEPS]
    out[-1] = np.log1p(size) / 10
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = raw(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([features(data[at[i] : at[i + 1]]).astype(np.float16).tobytes() for i in range(batch.num_rows)], pa.binary())], names=["x"])


def _matrix(rows: DataFrame) -> np.ndarray:
    found = rows.select("text").mapInArrow(lean(_rows), "x binary").toPandas().sort_values("x")
    return np.stack([np.frombuffer(x, np.float16) for x in found.x]) if len(found) else np.zeros((0, DIMS), np.float16)


def descend(pos: np.ndarray, unl: np.ndarray, prior: float | None, rounds: int = 40, rate: float = 0.01, ridge: float = 1e-4, batch: int = 512, seed: int = 5) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk by small batches; without a prior, tell positives from unlabelled."""
    rng = np.random.default_rng(seed)
    w = np.zeros(DIMS + 1)
    first, second, step = np.zeros_like(w), np.zeros_like(w), 0
    turns = max(1, (len(pos) + len(unl)) // batch)
    for turn in range(rounds):
        order_p, order_u = rng.permutation(len(pos)), rng.permutation(len(unl))
        for k in range(turns):
            xp, xu = pos[order_p[k::turns]].astype(np.float64), unl[order_u[k::turns]].astype(np.float64)
            if not len(xp) or not len(xu):
                continue
            zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
            up = lambda x, g: np.append(x.T @ g, g.sum()) / len(g)
            as_pos, p_as_neg, u_as_neg = up(xp, sigmoid(zp) - 1), up(xp, sigmoid(zp)), up(xu, sigmoid(zu))
            if prior is None:
                slope = (as_pos + u_as_neg) / 2
            else:
                negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                slope = prior * as_pos + (u_as_neg - prior * p_as_neg) if negative >= 0 else prior * p_as_neg - u_as_neg
            slope[:-1] += ridge * w[:-1]
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
            w -= rate * (1 - turn / (rounds + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of the shares above a score, on halves not trained on."""
    w, b = descend(pos[::2], unl[::2], None, rounds=15)
    sp, su = np.sort(pos[1::2] @ w + b), np.sort(unl[1::2] @ w + b)
    if not len(sp) or not len(su):
        return 0.5
    cuts = np.quantile(sp, np.linspace(0.0, 0.9, 91))
    qp = 1 - np.searchsorted(sp, cuts) / len(sp)
    qu = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(200.0) / 2) * (1 / np.sqrt(len(su)) + 1 / np.sqrt(len(sp)))
    best = int(np.argmin((qu + slack) / np.maximum(qp, 1e-9)))
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


def fit(positives: DataFrame, unlabelled: DataFrame) -> Model:
    """Fit on two bounded tables with a text column. Without either the score is one half for every text."""
    small_batches(positives.sparkSession)
    pos, unl = _matrix(positives), _matrix(unlabelled)
    if not len(pos) or not len(unl):
        return Model(np.zeros(DIMS), 0.0, 0.5)
    prior = estimate_prior(pos, unl)
    return Model(*descend(pos, unl, prior), prior)


def score(model: Model, data: np.ndarray) -> float:
    return float(sigmoid(features(data).astype(np.float64) @ model.weights + model.bias))


def predict(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row; a null text counts as empty and is scored.

    Whole texts are read, a bounded stretch at a time, with the n-grams across its
    ends. Repeated rows and equal texts get equal scores. An empty table gives an
    empty result. Other columns are ignored. The model's size is a parameter.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(1))
            found = [score(model, data[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {id_type}, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Positives: labelled 1 outside the held-out fold. Unlabelled: texts of all documents outside it, by a hash of doc_id and text; equal rows count once."""
    positives = labelled(docs, labels.where("quality = 1"), "quality", 5, 0, POSITIVES)
    rest = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(remainder(F.col("doc_id"), 5) != 0)
    return fit(positives, sampled(rest, UNLABELLED, rest.select("doc_id").count(), 13))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows, with all columns, whose text the model scores at the threshold or above.

    A null or empty text is scored like any other and goes or stays by its score;
    repeated rows go or stay together. An empty table stays empty. Columns of any
    name pass through.
    """
    return filter_rows(docs, lambda data, at: [score(model, data[a:b]) >= threshold for a, b in zip(at[:-1], at[1:], strict=True)])
