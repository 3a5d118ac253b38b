"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size; the
shards take turns, each claiming its next free slot, until the table is full. A
row's key hashes to a slot, so placement is one lookup in a table of constant
size, and adding or removing a shard moves little more than that shard's share.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.scratch import documents

#: Production parameters: 64 shards over a prime table of over 100 slots a shard.
SHARDS = 64
SLOTS = 8191


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index of the shard that holds it. Its size is the parameter ``slots``, whatever the data."""
    if not shards:
        raise ValueError("no shards")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names repeat")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime number, and no fewer than the shards")
    at = [_hash(s + "/offset") % slots for s in shards]
    skip = [_hash(s + "/skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as a DataFrame (slot, shard_no, shard) of ``slots`` rows, made by SQL functions from one literal."""
    numbers = F.split(F.lit(",".join(map(str, fill_table(shards, slots)))), ",")
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    rows = spark.range(1, numPartitions=1).select(F.posexplode(numbers).alias("slot", "n"))
    return rows.select("slot", F.col("n").cast("int").alias("shard_no"), F.element_at(names, F.col("n").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """32 bits of the key's MD5, modulo the table size; a null key counts as the empty string."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % slots).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Add ``slot``, ``shard_no`` and ``shard`` to every row; no shuffle.

    The table (``slots`` rows, a parameter) is broadcast. Null and empty keys
    share one slot; equal keys always get the same shard; an empty input gives no
    rows. Columns of ``df`` named like an added one are replaced.
    """
    kept = [c for c in df.columns if c not in ("slot", "shard_no", "shard")]
    if key not in kept:
        raise ValueError(f"the key may not be named {key}")
    left = df.select(*[F.col(f"`{c}`") for c in kept], slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    return left.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot").select(*[F.col(f"`{c}`") for c in kept], "slot", "shard_no", "shard")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir).select("doc_id"), "doc_id", shard_names())
