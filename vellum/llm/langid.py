"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed character n-grams of unit length. The vectors
of each language are clustered on the sphere; a text takes the language of the
nearest centroid by cosine, and is rejected if it is farther from that centroid than
nearly all of the centroid's own texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.learning import code_parts, folded_parts, gram_parts, has_letter, remainder
from vellum.llm.scratch import documents, lean, small_batches
from vellum.llm.textbytes import raw

DIMS = 4096
ORDERS = (1, 2, 3)
#: Texts of all languages together, and of each at most, that the centroids are fitted on.
SAMPLE, SAMPLE_EACH = 4000, 1000
CLUSTERS = 4


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    radius: np.ndarray  # distance beyond which a text is rejected


def counts(data: np.ndarray, step: int | None = None) -> np.ndarray:
    """How often each bucket's n-grams occur in a text; ``step`` bytes are met at a time, which changes nothing."""
    total = np.zeros(DIMS, np.float64)
    for g in gram_parts(folded_parts(code_parts(data, step)), ORDERS, DIMS):
        total += np.bincount(g, minlength=DIMS)
    return total


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = raw(batch.column(1))
        langs, found = [], []
        for i, lang in enumerate(batch.column(0).to_pylist()):
            own = data[at[i] : at[i + 1]]
            if has_letter(own):
                langs.append(lang)
                found.append(counts(own).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "tf"])


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors; starts from the mean and then from the text farthest from all so far."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    start = [v[int(np.argmax(v @ unit(v.mean(axis=0))))]]
    while len(start) < min(k, len(v)):
        start.append(v[int(np.argmin((v @ np.array(start).T).max(axis=1)))])
    c = np.array(start)
    for _ in range(rounds):
        at = np.argmax(v @ c.T, axis=1)
        c = np.array([unit(v[at == j].mean(axis=0)) if (at == j).any() else c[j] for j in range(len(c))])
    return c


def fit(docs: DataFrame, each: int = SAMPLE_EACH, total: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Fit on a sample of texts with a known language: bounded by ``each`` and ``total``, chosen by a hash of doc_id and text; equal rows count once."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return Model([], np.zeros((0, DIMS)), np.ones(DIMS), np.zeros(0))
    each = min(each, max(1, total // len(sizes)))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))) for lang, n in sizes.items()])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["doc_id", "lang", "text"])
    found = chosen.select("lang", "text").mapInArrow(lean(_features), "lang string, tf binary").toPandas()
    if not len(found):
        return Model([], np.zeros((0, DIMS)), np.ones(DIMS), np.zeros(0))
    found = found.sort_values(["lang", "tf"])
    tf = np.stack([np.frombuffer(x, np.float32) for x in found.tf])
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1
    v, lang = vectors(tf, idf).astype(np.float32), found.lang.to_numpy()
    names, centroids, radius = [], [], []
    for name in sorted(set(lang)):
        own = v[lang == name]
        c = cluster(own, clusters)
        near = own @ c.T
        for j in range(len(c)):
            mine = near[np.argmax(near, axis=1) == j, j]
            names.append(name)
            centroids.append(c[j])
            radius.append(1.25 * float(np.quantile(1 - mine, 0.99)) if len(mine) else 1.0)
    return Model(names, np.array(centroids, np.float64), idf, np.array(radius))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine with the nearest centroid) and rejected of every row.

    A null text and one without a letter are ``und`` with score 0 and rejected, as
    all texts are if nothing was learned. Ties go to the language that sorts first.
    Repeated rows each get their row, equal texts the same values. An empty table
    gives an empty result. Whole texts are read, a bounded stretch at a time, with
    the n-grams across its ends; other columns are ignored.
    The model has a fixed number of centroids a language, whatever the corpus.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                own = data[at[i] : at[i + 1]]
                if not model.langs or not has_letter(own):
                    out.append(("und", 0.0, True))
                    continue
                near = model.centroids @ vectors(counts(own), model.idf)
                j = int(np.argmax(near))
                out.append((model.langs[j], float(min(1.0, max(0.0, near[j]))), bool(1 - near[j] > model.radius[j])))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
