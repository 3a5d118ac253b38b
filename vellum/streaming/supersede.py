"""Supersession as a stream: each dropped file meets the earlier files of its stem as it arrives.

The stream is joined with itself. A file goes to the cell of its stem and its own span of
days as the newer one, and to that cell and the next span's as the older one, so a pair meets
in one cell, that of its newer file, in whatever order the two arrive, and a stem with many
files is spread by span. The join's state stays in the state store: no row of it passes
through Python. Age counts by the time of arrival, the stream's event time here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the rule: days within which an earlier file counts as superseded.
DAYS = 90
#: The state store that keeps state outside the heap.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def supersession(files: DataFrame, stem: str, at: str, key: str, days: int = DAYS, live_days: int = DAYS) -> DataFrame:
    """(stem, new_key, new_at, old_key, old_at, gap_days) of a stream of files, as the batch operator has them for dated rows.

    A pair comes out with the later of its two rows to arrive, so late rows find all
    their pairs as long as the state lives. A row that arrives again (same key and date)
    within ``live_days`` makes no new pair; the first stands for it, and so meets what
    arrives within twice ``live_days``. Then both are forgotten, as batches go on arriving.
    Rows without a date, which the batch operator holds to be always in the window, are left
    out here and can be queried there. The session must be set up by ``use_store``.
    """
    day = F.unix_date(F.col(at).cast("date"))
    dated = files.where(F.col(at).isNotNull() & F.col(stem).isNotNull())
    rows = dated.select(F.col(stem).alias("stem"), F.col(key).alias("file_key"), day.alias("day"), F.current_timestamp().alias("arrived"))
    # the watermark is half of live_days behind, and a row is known until half of live_days after its own time: live_days in all
    rows = rows.withWatermark("arrived", f"{live_days * 12} hours").dropDuplicatesWithinWatermark(["stem", "file_key", "day"])
    span = F.floor(F.col("day") / days)
    new = rows.select("stem", span.alias("span"), F.col("file_key").alias("new_key"), F.col("day").alias("new_day"), F.col("arrived").alias("new_arrived"))
    old = rows.select(F.col("stem").alias("old_stem"), F.explode(F.array(span, span + 1)).alias("old_span"), F.col("file_key").alias("old_key"), F.col("day").alias("old_day"), F.col("arrived").alias("old_arrived"))
    cell = (F.col("stem") == F.col("old_stem")) & (F.col("span") == F.col("old_span"))
    gap = F.col("new_day") - F.col("old_day")
    near = (F.col("old_day") < F.col("new_day")) & (gap <= days) & (F.col("new_key") != F.col("old_key"))
    live = F.expr(f"new_arrived BETWEEN old_arrived - INTERVAL {2 * live_days} DAYS AND old_arrived + INTERVAL {2 * live_days} DAYS")
    found = new.join(old, cell & near & live)
    return found.select("stem", "new_key", F.date_from_unix_date("new_day").alias("new_at"), "old_key", F.date_from_unix_date("old_day").alias("old_at"), gap.alias("gap_days"))


def use_store(spark: SparkSession) -> None:
    """Keep the session's streaming state in RocksDB: a join's in one store for each partition, not four, without a lookup at each write to count its rows, and without disk set aside beforehand, some 8 MB a store.

    No batch without rows is run: it would only forget, which the next one does too.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
