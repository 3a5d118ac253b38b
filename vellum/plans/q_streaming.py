"""Queries that run a stream over a table to its end and read the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.plans.q_ingest import _supersession_sql
from vellum.scratch import scratch_path
from vellum.session import table
from vellum.streaming import drops, supersede


def _events(spark, d):
    return drops.table_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, stream, name, mode="append"):
    """Results of every batch; in complete mode, of the last."""
    folder = scratch_path(spark, name)
    numbers: list[int] = []

    def sink(batch, number):
        drops.committed_once(f"{folder}/out")(batch, number)
        numbers.append(number)

    drops.run_batches(stream, sink, f"{folder}/checkpoint", mode)
    wanted = numbers[-1:] if mode == "complete" else numbers
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/out/batch_id={n}" for n in wanted])


def stream_dedup(spark, d):
    """Which files the stream saw, each once."""
    events = _events(spark, d).select(F.get_json_object("props", "$.k").alias("k"), "ts")
    return _run(spark, drops.first_seen(events, "k", "ts", "60 days"), "stream-dedup").select("k")


def stream_expiry_window(spark, d):
    agg = drops.windowed(_events(spark, d), "ts", "1 day", "1 hour", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return _run(spark, agg, "stream-window", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def stream_sliding(spark, d):
    agg = drops.windowed(_events(spark, d), "ts", "2 days", "1 hour", [], F.count("*").alias("n"), slide="1 day")
    return _run(spark, agg, "stream-sliding", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


def stream_session(spark, d):
    agg = drops.sessions(_events(spark, d), "ts", "6 hours", "1 day", ["user_id"], F.count("*").alias("n"))
    return _run(spark, agg, "stream-session", "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def stream_supersession(spark, d):
    """All orders as dropped files: the pairs that a stream of them makes, two batches in an order of their own."""
    supersede.use_store(spark)
    folder = scratch_path(spark, "stream-supersession")
    # the newest half of the keys comes first
    orders = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("stem"), F.col("o_orderdate").cast("date").alias("at"))
    for part in (1, 0):
        orders.where(F.col("o_orderkey") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(orders.schema).parquet(f"{folder}/in")
        found = supersede.supersession(stream, "stem", "at", "o_orderkey")
        found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out").select("stem", "new_key", "old_key", "gap_days")


QUERIES = {
    "stream_supersession": (stream_supersession, _supersession_sql("<=")),
    "stream_dedup": (stream_dedup, "SELECT DISTINCT props::JSON ->> 'k' AS k FROM events"),
    "stream_expiry_window": (stream_expiry_window, "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL"),
    "stream_sliding": (stream_sliding, "SELECT (date_trunc('day', ts) - to_days(k::INT))::TIMESTAMP AS start, count(*) AS n FROM events, range(2) t(k) GROUP BY 1"),
    "stream_session": (stream_session, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"),
}
