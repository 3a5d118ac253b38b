"""An append-only ledger of JSON lines, written and read by a Spark data source with its own commit.

Tasks stage files that nobody reads; the driver makes all of them visible at once by
moving one entry into the ledger's log. An entry lists the files of a batch with the byte
offset that each begins at, so every line has an offset of its own and an append knows
where it began. A batch whose name the log holds already adds nothing.

    <path>/data/<batch>/<task>.jsonl     staged, and read only if an entry names it
    <path>/log/<number>.json             one for each committed batch

One job at a time may commit to a ledger, as the lock of an ingestion run has it. Paths are
those of the Arrow file systems (file, s3, gs, hdfs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

FORMAT = "ledger"
#: Bytes of lines that a reader turns into one batch.
READ_BYTES = 1 << 22
LINES = "line string, manifest_offset long, n_bytes long, batch string"


class Folder:
    """A ledger's folder."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path)

    def entries(self) -> list[dict]:
        """What is committed, in order."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/log", allow_not_found=True))
        names = sorted(f.path for f in found if f.base_name.endswith(".json"))
        return [json.loads(self.fs.open_input_stream(name).read()) for name in names]

    def stage(self, batch: str) -> tuple[str, pa.NativeFile]:
        self.fs.create_dir(f"{self.root}/data/{batch}")
        name = f"data/{batch}/{uuid.uuid4().hex}.jsonl"
        return name, self.fs.open_output_stream(f"{self.root}/{name}")

    def drop(self, names: list[str]) -> None:
        from pyarrow import fs

        for name in names:
            if self.fs.get_file_info(f"{self.root}/{name}").type != fs.FileType.NotFound:
                self.fs.delete_file(f"{self.root}/{name}")

    def staged(self, batch: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/data/{batch}", allow_not_found=True))
        return [f"data/{batch}/{f.base_name}" for f in found]

    def commit(self, batch: str, files: list[dict], staged: str) -> None:
        """Make ``files``, staged under the name ``staged``, visible as one batch, unless it is there already; files of tries that do not count are dropped."""
        before = self.entries()
        known = {f["name"] for e in before for f in e["files"]}
        if any(e["batch"] == batch for e in before):
            self.drop([f["name"] for f in files if f["name"] not in known])
            return
        at = begin = before[-1]["end"] if before else 0
        for f in files:
            f["offset"] = at
            at += f["n_bytes"]
        entry = {"batch": batch, "offset": begin, "end": at, "n_lines": sum(f["n_lines"] for f in files), "files": files}
        self.fs.create_dir(f"{self.root}/log")
        name = f"{self.root}/log/{len(before):012d}.json"
        with self.fs.open_output_stream(f"{name}.part") as out:
            out.write(json.dumps(entry).encode())
        self.fs.move(f"{name}.part", name)
        self.drop([name for name in self.staged(staged) if name not in known | {f["name"] for f in files}])


@dataclass
class Staged(WriterCommitMessage):
    task: int
    name: str
    n_lines: int
    n_bytes: int


class _Lines:
    """Staging of lines by a task, and what a job does with all tasks' files."""

    def __init__(self, path: str, batch: str):
        self.path, self.batch = path, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        name, out = Folder(self.path).stage(self.batch)
        n_lines = n_bytes = 0
        with out:
            for lines in iterator:
                data = b"".join([line.encode() + b"\n" for line in lines.column(0).to_pylist()])
                out.write(data)
                n_lines += lines.num_rows
                n_bytes += len(data)
        return Staged(TaskContext.get().partitionId() if TaskContext.get() else 0, name, n_lines, n_bytes)

    def _commit(self, messages: list[Staged | None], batch: str) -> None:
        files = [{"name": m.name, "n_lines": m.n_lines, "n_bytes": m.n_bytes} for m in sorted((m for m in messages if m), key=lambda m: (m.task, m.name))]
        folder = Folder(self.path)
        empty = [f["name"] for f in files if not f["n_bytes"]]
        folder.commit(batch, [f for f in files if f["n_bytes"]], self.batch)
        folder.drop(empty)

    def _abort(self, messages: list[Staged | None]) -> None:
        Folder(self.path).drop([m.name for m in messages if m])


class LedgerWriter(_Lines, DataSourceArrowWriter):
    def commit(self, messages: list[Staged | None]) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages: list[Staged | None]) -> None:
        self._abort(messages)


class LedgerStreamWriter(_Lines, DataSourceStreamArrowWriter):
    """Each batch of a stream under the stream's name and the batch's number, so that a repeated batch adds nothing."""

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self._commit(messages, f"{self.batch}-{batchId}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self._abort(messages)


@dataclass
class Part(InputPartition):
    name: str
    offset: int
    batch: str


class LedgerReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        """A partition for each committed file."""
        found = [Part(f["name"], f["offset"], e["batch"]) for e in Folder(self.path).entries() for f in e["files"]]
        return found or [Part("", 0, "")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        folder, at, rest = Folder(self.path), partition.offset, b""
        with folder.fs.open_input_stream(f"{folder.root}/{partition.name}") as source:
            while data := source.read(READ_BYTES):
                *lines, rest = (rest + data).split(b"\n")
                sizes = [len(line) + 1 for line in lines]
                offsets = []
                for size in sizes:
                    offsets.append(at)
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array([line.decode() for line in lines], pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array([partition.batch] * len(lines), pa.string())], names=["line", "manifest_offset", "n_bytes", "batch"])


class LedgerSource(DataSource):
    """``path`` is the ledger's folder; ``batch`` names what a job appends."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LedgerReader:
        return LedgerReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LedgerWriter:
        if overwrite:
            raise ValueError("a ledger is only appended to")
        return LedgerWriter(self.options["path"], self.options["batch"])

    def streamWriter(self, schema, overwrite: bool) -> LedgerStreamWriter:  # noqa: N802
        return LedgerStreamWriter(self.options["path"], self.options["batch"])


def lines(files: DataFrame, *status: str) -> DataFrame:
    """A JSON line for each row and each ``status``, a row's statuses one after the other."""
    own = files.withColumn("status", F.explode(F.array(*map(F.lit, status)))) if status else files
    return own.select(F.to_json(F.struct("*")).alias("line"))


def append(files: DataFrame, path: str, batch: str) -> dict:
    """Commit ``files`` in two phases: an intent and a committed line of each file, all of them or none.

    Returns offset, end and n_lines of the batch. A batch that is there already adds no
    line and returns what its first try did. A job that fails, or is killed, leaves
    nothing that is read; what it staged is dropped by the next try of its name.
    """
    spark = files.sparkSession
    spark.dataSource.register(LedgerSource)
    if not (done := committed(path, batch)):
        lines(files, "intent", "committed").write.format(FORMAT).mode("append").option("path", path).option("batch", batch).save()
        done = committed(path, batch)
    return done


def committed(path: str, batch: str) -> dict:
    """Offset, end and n_lines of a batch; empty if it is not there."""
    return next(({k: e[k] for k in ("offset", "end", "n_lines")} for e in Folder(path).entries() if e["batch"] == batch), {})


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Committed lines as columns of ``schema``, with manifest_offset, n_bytes and batch."""
    spark.dataSource.register(LedgerSource)
    found = spark.read.format(FORMAT).option("path", path).load()
    return found.select(F.from_json("line", schema).alias("row"), "manifest_offset", "n_bytes", "batch").select("row.*", "manifest_offset", "n_bytes", "batch")


def append_stream(stream: DataFrame, path: str, name: str, checkpoint: str, *status: str):
    """A query that appends a stream's rows, each once over restarts from its checkpoint."""
    stream.sparkSession.dataSource.register(LedgerSource)
    writer = lines(stream, *status).writeStream.format(FORMAT).option("path", path).option("batch", name)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
