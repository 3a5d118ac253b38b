"""Streamed supersession against the batch operator: any order of arrival, restarts, late and repeated rows."""

import datetime
import random

from vellum.operators import ingest
from vellum.streaming import supersede

SCHEMA = "file_key long, stem string, day date"


def pairs(df):
    return sorted((r.stem, r.new_key, str(r.new_at), r.old_key, str(r.old_at), r.gap_days) for r in df.collect())


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    supersede.use_store(spark)
    rng = random.Random(1)
    start = datetime.date(1999, 12, 1)
    rows = [(i, rng.choice(["plan", "plan", "report", None]), start + datetime.timedelta(days=rng.randrange(400))) for i in range(150)]
    rows += [(1000, "plan", start), (1001, "plan", start + datetime.timedelta(days=90)), (1002, "plan", start + datetime.timedelta(days=91)), (1003, "plan", start)]
    rng.shuffle(rows)  # the oldest may come last
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for turn in range(2):  # a restart after each part; the last one comes twice
        part = rows[turn * 80 : turn * 80 + 80]
        for _ in range(1 + turn):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            query = supersede.supersession(stream, "stem", "day", "file_key").writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
            query.awaitTermination()
    files = spark.createDataFrame(rows, SCHEMA)
    want = ingest.supersession(files, "stem", "day", "file_key").select("stem", "new_key", "new_at", "old_key", "old_at", "gap_days")
    assert pairs(spark.read.parquet(out)) == pairs(want) and want.count() > 100


def run_parts(spark, tmp_path, parts, **more):
    """Pairs of a stream of ``parts``, one batch each, and each batch's report."""
    supersede.use_store(spark)
    reports = []
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = supersede.supersession(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "stem", "day", "file_key", **more)
        query = found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        reports.append(query.lastProgress)
    return [(r.new_key, r.old_key) for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()], found, reports


def test_no_row_of_the_state_passes_through_python(spark, tmp_path):
    """F8: with a call into Python for each cell, the seconds followed the number of cells."""
    start = datetime.date(2001, 1, 1)
    day = lambda n: start + datetime.timedelta(days=n)
    rows = [(i, f"s{i // 2}", day(40 * (i % 2))) for i in range(40)]  # two files a stem
    made, found, reports = run_parts(spark, tmp_path, [rows[20:] + rows[30:], rows])
    assert sorted(made) == [(i, i - 1) for i in range(1, 40, 2)]
    for plan in (found._jdf.queryExecution().analyzed().toString(), str([r["stateOperators"] for r in reports])):
        assert "python" not in plan.lower() and "pandas" not in plan.lower() and "transformWithState" not in plan
    names = [op["operatorName"] for op in reports[-1]["stateOperators"]]
    assert sorted(names) == ["dedupeWithinWatermark", "dedupeWithinWatermark", "symmetricHashJoin"]


def test_state_is_forgotten(spark, tmp_path):
    """With no days to live, files meet within their batch only, and the later batches remove what the first ones left."""
    start = datetime.date(2001, 1, 1)
    parts = [[(10 * k + i, "plan", start + datetime.timedelta(days=k + 10 * i)) for i in range(3)] for k in range(3)]
    made, _, reports = run_parts(spark, tmp_path, parts, live_days=0)
    assert sorted(made) == sorted((10 * k + i, 10 * k + j) for k in range(3) for i in range(3) for j in range(i))
    assert all(op["numRowsRemoved"] > 0 for op in reports[-1]["stateOperators"])
