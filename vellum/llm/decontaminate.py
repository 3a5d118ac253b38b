"""Benchmark decontamination with suffix arrays over the training texts.

Each shard of the corpus (a bounded number of words of whole documents, or of a
stretch of a very long one) gets a word-level suffix array, and every suffix of every
benchmark item is binary-searched in it. The words are numbered by the benchmark's
vocabulary: a word outside it ends a suffix, since no benchmark suffix goes on there.
Suffixes are ordered as far as the longest item reaches. The occurrences of windows
found that way are merged along their diagonals into longest verbatim matches with
their places. Shards are made and searched where their documents are read: nothing
is shuffled, and a passage that is in a third of the corpus costs each shard its own
occurrences only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.scratch import documents, filter_rows, lean, materialize, small_batches
from vellum.llm.textbytes import U, classes, raw, words

WINDOW = 10
#: Words of a shard.
SHARD = 1 << 20
#: Bytes of benchmark texts that are searched for at once; a larger benchmark goes through the corpus in blocks.
BLOCK_BYTES = 32 << 20

MEMBER = classes(False)


class Tests:
    """A block of benchmark items, numbered for searching."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window, self.names = window, [name for name, _ in items]
        hashes, spelt = [], {}
        for _, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            start, end, h = words(data, MEMBER)
            for s, e, x in zip(start, end, h.tolist(), strict=True):
                spelt[x] = bytes(data[s:e]).lower()
            hashes.append(h)
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, U)
        self.spelling = [b""] + [spelt[x] for x in self.vocabulary.tolist()]
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per = max(1, 64 // self.bits)  # words of a key
        self.depth = max([len(h) for h in hashes], default=0)
        numbers = [np.append(self.number(h), U(0)) for h in hashes]
        self.keys = self.pack(np.concatenate(numbers)) if numbers else np.zeros(0, U)
        item, at, size, base = [], [], [], 0
        for i, h in enumerate(hashes):
            for j in range(max(0, len(h) - window + 1) or (len(h) > 0)):
                item.append(i)
                at.append(base + j)
                size.append(min(window, len(h)))
            base += len(h) + 1
        self.item, self.at, self.size = np.array(item, np.int64), np.array(at, np.int64), np.array(size, np.int64)
        self.start = np.cumsum([0] + [len(n) for n in numbers])

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up by vocabulary, 0 for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), U)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(U)

    def pack(self, numbers: np.ndarray) -> np.ndarray:
        """The first words of each suffix as one key; nothing counts after its end."""
        padded = np.concatenate((numbers, np.zeros(self.per, U)))
        key = padded[: len(numbers)].copy()
        alive = key != 0
        for j in range(1, self.per):
            word = padded[j : j + len(numbers)]
            alive &= word != 0
            key = (key << U(self.bits)) | np.where(alive, word, U(0))
        return key

    def bounds(self, at: int, level: int, size: int) -> tuple[int, int] | None:
        """Least and greatest key, at a level, of the suffixes that share ``size`` words with the test suffix ``at``."""
        left = min(self.per, size - level * self.per)
        if left <= 0:
            return None
        drop = self.bits * (self.per - left)
        low = int(self.keys[at + level * self.per]) >> drop << drop
        return low, low | ((1 << drop) - 1)


def suffix_array(keys: np.ndarray, per: int, full: int, depth: int) -> np.ndarray:
    """Start positions of the suffixes that begin with a numbered word, in order of their first ``depth`` words.

    ``full`` masks the last word of a key: keys that end before it need no further comparison.
    """
    order = np.flatnonzero(keys)
    order = order[np.argsort(keys[order], kind="stable")]
    at, level, last = np.arange(len(order)), 0, keys[order]
    group = np.zeros(len(order), np.int64)
    while len(at):
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = (last[1:] == last[:-1]) & (group[1:] == group[:-1]) & ((last[1:] & U(full)) != 0)
        tied = same[:-1] | same[1:]
        level += 1
        if level * per >= depth or not tied.any():
            break
        group = np.cumsum(~same[:-1])[tied]
        at = at[tied]
        here = order[at]
        beyond = here + level * per
        last = np.where(beyond < len(keys), keys[np.minimum(beyond, len(keys) - 1)], U(0))
        again = np.lexsort((last, group))
        order[at], last, group = here[again], last[again], group[again]
    return order


def search(keys: np.ndarray, order: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of windows as (number of the window, place), by binary search of their suffixes in a suffix array."""
    if not len(order) or not len(tests.at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = keys[order]
    edge = [tests.bounds(int(a), 0, int(s)) for a, s in zip(tests.at, tests.size, strict=True)] if not hasattr(tests, "edge") else None
    if edge is not None:
        tests.edge = (np.array([e[0] for e in edge], U), np.array([e[1] for e in edge], U))
    low = np.searchsorted(first, tests.edge[0], "left")
    high = np.searchsorted(first, tests.edge[1], "right")
    which, place = [], []
    for k in np.flatnonzero(high > low):
        a, b, level = int(low[k]), int(high[k]), 1
        while a < b and (bound := tests.bounds(int(tests.at[k]), level, int(tests.size[k]))):
            beyond = order[a:b] + level * tests.per
            column = np.where(beyond < len(keys), keys[np.minimum(beyond, len(keys) - 1)], U(0))
            a, b = a + int(np.searchsorted(column, U(bound[0]), "left")), a + int(np.searchsorted(column, U(bound[1]), "right"))
            level += 1
        if a < b:
            which.append(np.full(b - a, k))
            place.append(order[a:b])
    return (np.concatenate(which), np.concatenate(place)) if which else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _shards(numbers: list[np.ndarray], overlap: int, limit: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of (document, first word, numbers) of about ``limit`` words; a longer document is cut with an overlap."""
    shard, held = [], 0
    for i, n in enumerate(numbers):
        for start in range(0, max(1, len(n) - overlap), limit):
            piece = n[start : start + limit + overlap]
            if shard and held + len(piece) > limit:
                yield shard
                shard, held = [], 0
            shard.append((i, start, piece))
            held += len(piece)
    if shard:
        yield shard


def find(data: np.ndarray, at: np.ndarray, tests: Tests, limit: int = SHARD) -> Iterator[tuple[int, np.ndarray, list[tuple[str, int, int, int]]]]:
    """For each document: its number of words, which are hit, and its longest matches (item, word of the item, word, words)."""
    found = [words(data[a:b], MEMBER) for a, b in zip(at[:-1], at[1:], strict=True)]
    numbers = [tests.number(h) for _, _, h in found]
    hits: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    full = (1 << tests.bits) - 1
    for shard in _shards(numbers, tests.window - 1, limit):
        joined = np.concatenate([x for _, _, n in shard for x in (n, np.zeros(1, U))])
        base = np.cumsum([0] + [len(n) + 1 for _, _, n in shard])
        while True:
            keys = tests.pack(joined)
            which, place = search(keys, suffix_array(keys, tests.per, full, tests.depth), tests)
            wrong = []
            of = np.searchsorted(base, place, "right") - 1
            for k in np.unique(np.concatenate([place[tests.size[which] > j] + j for j in range(tests.window)])) if len(place) else ():
                j = int(np.searchsorted(base, k, "right") - 1)
                i, start, n = shard[j]
                if k - base[j] < len(n) and joined[k]:
                    s, e, _ = found[i]
                    w = int(k - base[j] + start)
                    if bytes(data[at[i] + s[w] : at[i] + e[w]]).lower() != tests.spelling[int(joined[k])]:
                        wrong.append(k)
            if not wrong:
                break
            joined[wrong] = 0  # another word of the same hash
        for j in np.unique(of):
            mine = of == j
            i, start, _ = shard[j]
            hits.setdefault(i, []).append((which[mine], place[mine] - base[j] + start))
    for i, (starts, _, _) in enumerate(found):
        hit = np.zeros(len(starts), bool)
        matches: list[tuple[str, int, int, int]] = []
        if i in hits:
            which, place = (np.concatenate(x) for x in zip(*hits[i], strict=True))
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + tests.size[which], -1)
            hit = np.cumsum(edge)[:-1] > 0
            item = tests.item[which]
            inner = tests.at[which] - tests.start[item]
            rows = np.unique(np.stack([item, place - inner, place, tests.size[which]], axis=1), axis=0)
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1) | (rows[1:, 2] != rows[:-1, 2] + 1)
            first = np.flatnonzero(new)
            for a, b in zip(first, np.append(first[1:], len(rows)), strict=True):
                matches.append((tests.names[rows[a, 0]], int(rows[a, 2] - rows[a, 1]), int(rows[a, 2]), int(b - a - 1 + rows[a, 3])))
        yield len(starts), hit, matches


MATCH = "array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"


def _scan(tests: Tests, limit: int):
    """Adds a block's hits and matches to those so far (doc_id, text, hit words as packed bits, matches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(1))
            bits, matches, sizes = [], [], []
            for (n, hit, more), old, so_far in zip(find(data, at, tests, limit), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if old:
                    hit = hit | np.unpackbits(np.frombuffer(old, np.uint8), count=n).astype(bool)
                bits.append(np.packbits(hit).tobytes() if hit.any() else b"")
                matches.append((so_far or []) + [dict(zip(("item_id", "item_word", "doc_word", "n_words"), m, strict=True)) for m in more])
                sizes.append(n)
            kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array(matches, kind), pa.array(sizes, pa.int64())], names=["doc_id", "text", "bits", "matches", "n_words"])

    return run


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit = [int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) if b else 0 for b in batch.column(1).to_pylist()]
        items = [sorted({m["item_id"] for m in found}) for found in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(3), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), batch.column(2)],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"],
        )


def blocks(bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[Tests, bool]]:
    """The benchmark in blocks of about ``block_bytes``, by a hash of the text, and whether a block is the last; the driver holds one at a time."""
    bench = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for k in range(n):
        rows = bench.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        yield Tests(sorted((r.item_id, r.text) for r in rows), window), k == n - 1


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, limit: int = SHARD) -> DataFrame:
    """One row for every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, matches.

    ``matches`` lists the longest verbatim matches of ``window`` words or more (or of a
    whole shorter item): item_id, first word in the item and in the document, words.
    Every suffix of an item that begins with a window is searched; a shorter one holds
    none. A null text has no words, on either side; an item of fewer than ``window``
    words, but not none, is one window. Items that share an item_id count once; a null
    item_id counts as the empty string. Repeated rows each get their row. An empty
    table on either side gives no hits. A very long text is searched whole, in
    stretches that overlap by a window. Other columns are ignored.

    After each block of a benchmark larger than ``block_bytes`` the result so far is
    written with the texts, so no plan and no driver holds more than one block.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("binary").alias("bits"), F.lit(None).cast(MATCH).alias("matches"))
    for tests, last in blocks(bench, window, block_bytes):
        found = found.mapInArrow(lean(_scan(tests, limit)), f"doc_id {id_type}, text string, bits binary, matches {MATCH}, n_words long").select("doc_id", "text", "bits", "matches", "n_words")
        if not last:
            found = materialize(found, "scanned-block")
    return found.select("doc_id", "bits", "matches", "n_words").mapInArrow(lean(_report), f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, matches {MATCH}")


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, limit: int = SHARD) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no window of any benchmark item.

    A null or empty text holds none and stays; repeated rows go or stay together. An
    empty table on either side drops nothing. Texts of any length are searched whole;
    columns of any name pass through. After each block of a large benchmark the rows
    left are written.
    """
    for tests, last in blocks(bench, window, block_bytes):
        docs = filter_rows(docs, lambda data, at, tests=tests: [not hit.any() for _, hit, _ in find(data, at, tests, limit)])
        if not last:
            docs = materialize(docs, "clean-of-block")
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan`` with its matches as their number, the longest one's words, and a digest of item_id:item_word:doc_word:n_words, each once, sorted, comma-joined."""
    found = scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    said = F.array_sort(F.array_distinct(F.transform("matches", lambda m: F.concat_ws(":", m["item_id"], m["item_word"], m["doc_word"], m["n_words"]))))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0)).cast("long")
    return found.select("*", F.size(said).cast("long").alias("n_matches"), longest.alias("longest_match"), F.sha2(F.array_join(said, ","), 256).alias("matches_sha256")).drop("matches")
