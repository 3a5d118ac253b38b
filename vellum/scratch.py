"""Tables that cut a long lineage, in the folder that the cluster shares; batches that bound a Python worker's memory."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of a scratch table; a writer holds one in memory.
ROW_GROUP = 8 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder ``spark.checkpoint.dir``; where it is unset, a local one under a local master and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder."""
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size, so that a Python worker's memory does not follow the row count."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def lean(run):
    """``run`` over batches, giving freed memory back to the system when a task ends.

    Workers are used again by other tasks; else each would keep for its whole life what
    its largest task held.
    """

    def held(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
        if trim:
            trim(0)

    return held
