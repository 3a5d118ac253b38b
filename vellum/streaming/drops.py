"""Incremental forms: a drop zone, deduplication as keyed state, windows over events.

Each runs the files that are there (``availableNow``) with its checkpoint in a folder
of its own; started again, it takes up where it ended. The checkpoint replaces a lock
and the intent and commit rows of a two-phase commit: a batch that was cut short is
run again under the same id, and its sink replaces what the first try left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; rows go to Parquet under ``path``."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def files(spark: SparkSession, path: str, glob: str = "*", most: int = 1000) -> DataFrame:
    """Dropped files, oldest first, with their bytes."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", most).load(path)


def table_stream(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """A Parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    return reader.option("pathGlobFilter", name).parquet(folder)


def committed_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that a repeated batch overwrites: one folder for each batch id."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")


def first_seen(stream: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Each key's first row. State is kept for ``late`` of event time; the reference never forgets, an unbounded state."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, size: str, late: str, by: list[str], *aggregates, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; rows later than ``late`` are left out."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    out = stream.withWatermark(at, late).groupBy(window.alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def sessions(stream: DataFrame, at: str, gap: str, late: str, by: list[str], *aggregates) -> DataFrame:
    out = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(*aggregates)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])
