"""The ledger's commit: all or nothing, each batch once, offsets of lines, streams over restarts."""

import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import udf

from vellum.sources import ledger

SCHEMA = "run_id string, sha256 string, status string"


def files(spark, ids):
    return spark.createDataFrame([("run", f"é{i}") for i in ids], "run_id string, sha256 string").repartition(3)


def test_append_read_and_repeat(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    assert ledger.read(spark, path, SCHEMA).count() == 0
    first = ledger.append(files(spark, range(10)), path, "a")
    assert first["offset"] == 0 and first["n_lines"] == 20
    second = ledger.append(files(spark, range(10, 15)), path, "b")
    assert second["offset"] == first["end"] and second["n_lines"] == 10
    assert ledger.append(files(spark, range(99)), path, "b") == second  # a repeated batch
    rows = sorted(ledger.read(spark, path, SCHEMA).collect(), key=lambda r: r.manifest_offset)
    assert [r.status for r in rows] == ["intent", "committed"] * 15
    assert sorted({r.sha256 for r in rows}) == sorted(f"é{i}" for i in range(15)) and {r.batch for r in rows} == {"a", "b"}
    at = 0
    for r in rows:  # no gap and no overlap
        assert r.manifest_offset == at
        at += r.n_bytes
    assert at == second["end"]
    assert ledger.append(files(spark, []), path, "none") == {"offset": at, "end": at, "n_lines": 0}
    with pytest.raises(Exception, match="only appended"):
        ledger.lines(files(spark, [1])).write.format(ledger.FORMAT).mode("overwrite").option("path", path).option("batch", "x").save()


def test_failed_and_killed_jobs_leave_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    ledger.append(files(spark, range(3)), path, "before")

    @udf("string")
    def broken(x):
        if x == "é7":
            raise ValueError("a task fails")
        return x

    with pytest.raises(Exception, match="a task fails"):
        ledger.append(files(spark, range(20)).withColumn("sha256", broken("sha256")), path, "x")

    @udf("string")
    def slow(x):
        time.sleep(60 if x == "é5" else 0)
        return x

    failed = []

    def run():
        spark.sparkContext.addJobTag("slow-append")
        try:
            ledger.append(files(spark, range(20)).withColumn("sha256", slow("sha256")), path, "x")
        except Exception as error:
            failed.append(error)

    thread = threading.Thread(target=run)
    thread.start()
    end = time.time() + 60
    while time.time() < end and not any((tmp_path / "ledger/data").glob("x/*")):
        time.sleep(0.2)
    while thread.is_alive():
        spark.sparkContext.cancelAllJobs()
        thread.join(0.5)
    assert failed
    assert ledger.read(spark, path, SCHEMA).count() == 6 and not ledger.committed(path, "x")
    done = ledger.append(files(spark, range(20)), path, "x")  # tried again
    assert done["n_lines"] == 40 and ledger.read(spark, path, SCHEMA).where("batch = 'x'").count() == 40
    assert len(list((tmp_path / "ledger/data/x").iterdir())) == len(next(e for e in ledger.Folder(path).entries() if e["batch"] == "x")["files"])


def test_a_driver_that_dies_before_or_in_the_commit(spark, tmp_path):
    import pyarrow as pa

    path = f"file://{tmp_path}/ledger"
    writer = ledger.LedgerWriter(path, "x")
    part = lambda: iter([pa.RecordBatch.from_arrays([pa.array(["{}"])], names=["line"])])
    staged = [writer.write(part()), writer.write(part())]
    assert ledger.read(spark, path, SCHEMA).count() == 0
    (tmp_path / "ledger/log").mkdir()
    (tmp_path / "ledger/log/000000000000.json.part").write_text('{"batch"')  # cut off while it was written
    assert ledger.read(spark, path, SCHEMA).count() == 0
    again = [writer.write(part()), None]
    writer.commit(again)
    writer.commit(staged)  # the first try comes late
    assert ledger.read(spark, path, SCHEMA).count() == 1
    assert [f.name for f in (tmp_path / "ledger/data/x").iterdir()] == [again[0].name.rpartition("/")[2]]


def test_streams_append_each_row_once(spark, tmp_path):
    path, source = f"file://{tmp_path}/ledger", f"{tmp_path}/in"
    for turn in range(2):
        files(spark, range(turn * 10, turn * 10 + 10)).write.mode("append").parquet(source)
        for _ in range(2):  # the second time there is nothing new
            stream = spark.readStream.schema("run_id string, sha256 string").option("maxFilesPerTrigger", 2).parquet(source)
            ledger.append_stream(stream, path, "drops", f"{tmp_path}/checkpoint", "committed").awaitTermination()
    rows = ledger.read(spark, path, SCHEMA).collect()
    assert sorted(r.sha256 for r in rows) == sorted(f"é{i}" for i in range(20))
    # the log of the stream is lost after its last batch: the batch runs again under its number
    last = max((tmp_path / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.with_name(f".{last.name}.crc").unlink()
    last.unlink()
    stream = spark.readStream.schema("run_id string, sha256 string").option("maxFilesPerTrigger", 2).parquet(source)
    ledger.append_stream(stream, path, "drops", f"{tmp_path}/checkpoint", "committed").awaitTermination()
    assert ledger.read(spark, path, SCHEMA).agg(F.count("*"), F.countDistinct("sha256")).first()[:] == (20, 20)
