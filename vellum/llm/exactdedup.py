"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is its bytes read as the digits of a number, in two bases, modulo
a prime. Fingerprints compose: that of ``a + b`` is that of ``a`` shifted by the length of
``b``, plus that of ``b``. So the chunks of a huge text are hashed by many tasks and
their hashes, each shifted by the bytes that follow it, are summed in any order.
Texts of equal fingerprint and length are compared with one of them, chunk by chunk;
the chunks of huge ones meet as rows of their own, in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.scratch import documents, keep_rows, lean, materialize, sized, small_batches
from vellum.llm.textbytes import raw

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_223)
#: Bytes of a chunk, of which sums stay below 2**64.
CHUNK = 1 << 18
#: Texts of more bytes are hashed by several tasks.
HUGE = 1 << 24
#: Members of a group of copies that are compared in one task before the group is salted.
GROUP = 256

_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """For each base its powers from the CHUNK-1st down to the 0th."""
    if not _POWERS:
        for base in BASES:
            row, x = np.empty(CHUNK, np.uint64), 1
            for i in range(CHUNK - 1, -1, -1):
                row[i] = x
                x = x * base % PRIME
            _POWERS.append(row)
    return _POWERS


def chunk_hash(data: np.ndarray) -> tuple[int, int]:
    """Hash of at most CHUNK bytes for each base; digits are byte + 1, so that leading zero bytes count."""
    digits = data.astype(np.uint64) + np.uint64(1)
    return tuple(int(digits @ row[CHUNK - len(digits) :]) % PRIME for row in _powers()) if len(digits) else (0, 0)


def compose(left: tuple[int, int], right: tuple[int, int], right_size: int) -> tuple[int, int]:
    """Hash of a text from those of its two parts."""
    return tuple((a * pow(base, right_size, PRIME) + b) % PRIME for a, b, base in zip(left, right, BASES, strict=True))


def text_hash(data: np.ndarray) -> tuple[int, int]:
    value = (0, 0)
    for i in range(0, len(data), CHUNK):
        part = data[i : i + CHUNK]
        value = compose(value, chunk_hash(part), len(part))
    return value


def _pack(value: tuple[int, int]) -> int:
    return value[0] << 32 | value[1]


def _fingerprints(huge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(1))
            sizes = np.diff(at)
            prints = [None if sizes[i] > huge else _pack(text_hash(data[at[i] : at[i + 1]])) for i in range(len(sizes))]
            shas = [hashlib.sha256(data[at[i] : at[i + 1]]).hexdigest() for i in range(len(sizes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_bytes", "fingerprint", "text_sha256"])

    return run


def _chunk_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_sha256, after, chunk) -> each chunk's hash, shifted by the bytes after it."""
    for batch in batches:
        data, at = raw(batch.column(3))
        shifted = [compose(chunk_hash(data[at[i] : at[i + 1]]), (0, 0), after) for i, after in enumerate(batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in shifted], pa.int64()), pa.array([x[1] for x in shifted], pa.int64())], names=["doc_id", "text_sha256", "a", "b"])


def fingerprints(docs: DataFrame, id_type: str, huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes, fingerprint, text_sha256 and a number of its own of every row, in a written table."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = f"doc_id {id_type}, n_bytes long, fingerprint long, text_sha256 string"
    table = materialize(docs.mapInArrow(lean(_fingerprints(huge)), schema).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    if not table.where("fingerprint is null").limit(1).count():
        return table
    told = docs.where(F.octet_length("text") > huge).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).dropDuplicates(["doc_id", "text_sha256"])
    chunks = chunked(told, "doc_id", "text_sha256").repartition(F.hash("text_sha256", "after"))
    whole = (
        chunks.select("doc_id", "text_sha256", "after", "chunk").mapInArrow(lean(_chunk_hashes), f"doc_id {id_type}, text_sha256 string, a long, b long")
        .groupBy("doc_id", "text_sha256")
        .agg((F.sum("a") % PRIME).alias("a"), (F.sum("b") % PRIME).alias("b"))
        .select(F.col("doc_id").alias("huge_id"), F.col("text_sha256").alias("huge_sha"), (F.shiftleft("a", 32).bitwiseOR(F.col("b"))).alias("composed"))
    )
    joined = table.join(whole, F.col("doc_id").eqNullSafe(F.col("huge_id")) & (F.col("text_sha256") == F.col("huge_sha")), "left")
    return materialize(joined.select("doc_id", "n_bytes", F.coalesce("fingerprint", "composed").alias("fingerprint"), "text_sha256", "row"), "fingerprints-whole")


def chunked(texts: DataFrame, *kept: str) -> DataFrame:
    """A row for each chunk of each text: the columns ``kept``, its number, the bytes after it, its bytes."""
    size = F.octet_length("text").cast("long")
    rows = texts.select(*kept, size.alias("size"), F.col("text").cast("binary").alias("bytes"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / CHUNK))).alias("part"))
    return rows.select(*kept, "part", F.greatest(F.col("size") - (F.col("part") + 1) * CHUNK, F.lit(0)).alias("after"), F.expr(f"substring(bytes, cast(part * {CHUNK} + 1 as int), {CHUNK})").alias("chunk"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, at = raw(batch.column(2))
        right, by = raw(batch.column(3))
        same = []
        for i in range(batch.num_rows):
            a, b = left[at[i] : at[i + 1]], right[by[i] : by[i + 1]]
            same.append(len(a) == len(b) and all(np.array_equal(a[j : j + CHUNK], b[j : j + CHUNK]) for j in range(0, len(a), CHUNK)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], names=["fingerprint", "n_bytes", "same"])


def dedup(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """One row for every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; of repeated rows with that
    doc_id, one. A null text counts as empty; a null doc_id is below all others. No
    normalisation. Other columns are ignored. An empty table gives an empty result.
    Texts of any length are compared whole; those over ``huge`` bytes meet chunk by
    chunk.

    Groups are aggregated before they are joined to their rows. A large group is
    compared in as many tasks as its size asks for: its representative's text is
    repeated once for each. Should texts of equal fingerprint differ, those of one
    doc_id included, their group is split by SHA-256.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    key = ["fingerprint", "n_bytes"]
    table = fingerprints(docs, id_type, huge)
    groups = materialize(table.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "text_sha256")).alias("rep")).where("n > 1"), "copy-groups")
    members = materialize(table.join(sized(groups), key).select("doc_id", *key, "text_sha256", "n", "rep").dropDuplicates(["doc_id", *key, "text_sha256"]), "copy-members")
    at = members.select(F.col("doc_id").alias("member_id"), F.col("text_sha256").alias("sha"), *key, "n", "rep")
    # by the text too, so that rows without a doc_id do not all meet
    texts = docs.join(sized(at), F.col("doc_id").eqNullSafe(F.col("member_id")) & (F.sha2(F.col("text").cast("binary"), 256) == F.col("sha")))
    texts = texts.withColumn("salts", F.ceil(F.col("n") / GROUP).cast("int")).dropDuplicates(["member_id", "sha"])
    large = groups.where(F.col("n_bytes") > huge).limit(1).count() > 0
    if large:
        whole_texts, texts = texts.where(F.col("n_bytes") > huge), texts.where(F.col("n_bytes") <= huge)
    # by the text too: another text of the representative's doc_id is compared like any other
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("sha") == F.col("rep.text_sha256"))
    reps = texts.where(is_rep).dropDuplicates(key).select(*key, F.col("text").alias("rep_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    others = texts.where(~is_rep).select(*key, "text", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"))
    pairs = others.join(reps.hint("merge"), [*key, "salt"]).select(*key, "text", "rep_text")
    differ = pairs.mapInArrow(lean(_compare), "fingerprint long, n_bytes long, same boolean").where("not same").select(*key)
    if large:
        first = chunked(whole_texts.where(is_rep).dropDuplicates(key), *key).select(*key, "part", F.col("chunk").alias("rep_chunk"))
        differ = differ.unionByName(chunked(whole_texts.where(~is_rep), *key).join(first.hint("merge"), [*key, "part"]).where("chunk <> rep_chunk").select(*key))
    split = materialize(differ.distinct().withColumn("collided", F.lit(True)), "collisions")

    if split.limit(1).count():
        rows = table.join(sized(split), key, "left").withColumn("part", F.when(F.col("collided"), F.col("text_sha256")).otherwise("")).drop("collided")
    else:
        rows = table.withColumn("part", F.lit(""))
    whole = [*key, "part"]
    final = rows.join(sized(groups.select(*key)), key, "left_semi").groupBy(*whole).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top"))
    out = rows.join(sized(materialize(final, "copy-final")), whole, "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("top.row"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay: one of each group of equal texts, as ``dedup`` has it.

    A null text is an empty one; a null doc_id is below all others. Of repeated rows
    one stays; of rows that share a doc_id, only those with a copied text may go. An
    empty table stays empty; texts of any length and columns of any name pass through.
    """
    found = materialize(dedup(docs), "dedup-rows").select("doc_id", F.col("text_sha256").alias("text_key"), "kept")
    return keep_rows(docs, found, lambda text: F.sha2(text.cast("binary"), 256))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
