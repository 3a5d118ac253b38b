"""What the trained operators share: the held-out split, bounded samples, character codes, summed counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.scratch import lean, materialize
from vellum.llm.textbytes import U, mix

#: Cells of a count table that travel in one row.
SEGMENT = 4096
#: Bytes of a text that are decoded at a time; it bounds a worker's memory and changes no result.
STEP = 1 << 16


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def sampled(df: DataFrame, want: int, rows: int, seed: int) -> DataFrame:
    """About ``want`` of ``rows`` rows (doc_id, text), chosen by a hash of both; all if there are no more. Equal rows count once."""
    if rows > want:
        df = df.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * want / rows))
    return df.dropDuplicates(["doc_id", "text"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, by: int, held: int, want: int) -> DataFrame:
    """doc_id, text and label of about ``want`` labelled rows outside the held-out fold, in a written table.

    Of several labels of a document the greatest counts; those other than 0 and 1 are
    passed over. Equal rows count once; of a doc_id with many texts, the texts are
    sampled like others.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.where(remainder(F.col("doc_id"), by) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = rows.count()
    if n > want:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * want / n))
    # about want narrow rows, a parameter, so they may be broadcast
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    found = materialize(found.dropDuplicates(["doc_id", "text"]), "labelled")
    return sampled(found, want, found.count(), 12)


_TABLES: dict[str, np.ndarray] = {}
#: What each table says of a character.
_RULES = {
    "letter": (np.bool_, str.isalpha),
    "folded": (np.uint32, lambda c: (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 32),
    "kind": (np.uint32, lambda c: 97 if c.islower() else 65 if c.isupper() else 120 if c.isalpha() else 48 if c.isdigit() else ord(c) if ord(c) < 128 else 1),
}


def _table(name: str) -> np.ndarray:
    """A rule for every code point, made on first use without a list of them; surrogates count as spaces."""
    if name not in _TABLES:
        kind, rule = _RULES[name]
        _TABLES[name] = np.fromiter((rule(" " if 0xD800 <= i < 0xE000 else chr(i)) for i in range(0x110000)), kind, 0x110000)
    return _TABLES[name]


def codes(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def code_parts(data: np.ndarray, step: int | None = None) -> Iterator[np.ndarray]:
    """``codes`` in parts of about ``step`` bytes, cut between characters."""
    step = step or STEP
    at = 0
    while at < len(data):
        to = min(len(data), at + step)
        while to < len(data) and to - at < step + 4 and data[to] & 0xC0 == 0x80:
            to += 1
        yield codes(data[at:to])
        at = to


def has_letter(data: np.ndarray) -> bool:
    return any(_table("letter")[part].any() for part in code_parts(data))


def folded_parts(parts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Lower-case letters with one space for every run of anything else, and a space at either end, part by part."""
    last, first = 32, [32]
    for part in parts:
        part = _table("folded")[part]
        keep = (part != 32) | (np.concatenate(([last], part[:-1])) != 32)
        yield np.concatenate((first, part[keep])).astype(np.uint32)
        last, first = part[-1], []
    yield np.array(first + [32] * int(last != 32), np.uint32)


def kinds(points: np.ndarray) -> np.ndarray:
    """Letters by case, digits as one, ASCII marks as they are."""
    return _table("kind")[points]


def grams(points: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of each n-gram."""
    if len(points) < n:
        return np.zeros(0, np.int64)
    m = len(points) - n + 1
    value = np.full(m, n, U)
    for j in range(n):
        value = value * U(0x100000001B3) + points[j : j + m].astype(U)
    return (mix(value) & U(buckets - 1)).astype(np.int64)


def gram_parts(parts: Iterable[np.ndarray], orders: tuple[int, ...], buckets: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text that comes in parts: those across a cut too, each once."""
    tail = np.zeros(0, np.uint32)
    for part in parts:
        whole = np.concatenate((tail, part))
        for n in orders:
            yield grams(whole[max(0, len(tail) - n + 1) :], n, buckets)
        tail = whole[max(0, len(whole) - max(orders) + 1) :]


def segments(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Non-empty segments of a table of counts."""
    for i in range(0, len(counts), SEGMENT):
        part = counts[i : i + SEGMENT]
        if part.any():
            yield i // SEGMENT, part.astype(np.uint32).tobytes()


def sum_segments(df: DataFrame, cells: int) -> np.ndarray:
    """Sum of the tables whose segments ``df`` (segment int, counts binary) holds.

    A task streams over the rows of its segments; what comes to the driver has the
    size of one table, a parameter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(blob, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["segment", "counts"])

    out = np.zeros(-(-cells // SEGMENT) * SEGMENT, np.int64)
    for row in df.repartition("segment").mapInArrow(lean(run), "segment int, counts binary").toLocalIterator():
        out[row.segment * SEGMENT : (row.segment + 1) * SEGMENT] = np.frombuffer(row.counts, np.int64)
    return out[:cells]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
