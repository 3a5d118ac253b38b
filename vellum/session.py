"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings; ``master`` only for local runs."""
    builder = SparkSession.builder.appName("vellum")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Tables of texts, on which the work of a row is worth moving it, as long as they are no larger.
TEXTS, SMALL = ("documents", "pages"), 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one of texts in fewer files than there are cores is dealt out to all cores.

    A file may be one row group, which one task reads. A table of more than SMALL bytes
    has many of them, however few its files, and is never moved.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    few = name in TEXTS and len(df.inputFiles()) < cores
    return df.repartition(cores) if few and size_of(df) <= SMALL else df


def size_of(df: DataFrame) -> int:
    """Bytes of a table's files, by the optimizer's estimate."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
