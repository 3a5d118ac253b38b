"""Line deduplication with content-defined chunks of lines.

A rolling hash over the hashes of the last lines chooses where chunks end, so an
inserted line moves no boundary but those beside it. Chunks that occur again anywhere in
the corpus are seeds: each is grown by a line to either side, and of the stretches of two
lines or more that this gives, those that occur again, byte for byte, are removed
there; the first occurrence (least doc_id, then least place) removes nothing. Stretches
that overlap make up the whole repeated passage; a line that repeats without a neighbour
stays. Most chunks are one line long, since a longer one misses the passages that begin or
end within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.scratch import documents, lean, materialize, sized, small_batches
from vellum.llm.textbytes import EXACT, LINE, U, mix, raw, words

#: Factor of the rolling hash over lines.
ROLL = 0x9E3779B97F4A7C15
#: Lines that a boundary depends on, and of how many places one has no boundary.
CHUNKS = WINDOW, EVERY = 2, 64
#: Occurrences of an anchor that are compared in one task before it is salted.
GROUP = 512


def chunks_of(hashes: np.ndarray, window: int = WINDOW, every: int = EVERY) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each chunk.

    A chunk ends after every line but those where the rolling hash over the hashes of the
    last ``window`` lines is divisible by ``every``, so boundaries follow from the lines
    around them alone and a passage that is moved keeps its own.
    """
    value = np.zeros(len(hashes), U)
    for back in range(min(window, len(hashes)) - 1, -1, -1):
        value[back:] = value[back:] * U(ROLL) + hashes[: len(hashes) - back]
    ends = mix(value) % U(every) != 0
    if len(ends):
        ends[-1] = True
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    return first, last


def rolled(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each stretch of lines; that of equal stretches is equal, wherever a chunk ends."""
    value = hashes[first]
    for k in range(1, int((last - first).max(initial=0)) + 1):
        more = first + k <= last
        value[more] = value[more] * U(ROLL) + hashes[first[more] + k]
    return mix(value).view(np.int64)


def anchors(data: np.ndarray, window: int = WINDOW, every: int = EVERY) -> dict[str, np.ndarray]:
    """The chunks of a text: number of the first line, lines, hash, first byte and byte after the last; and of each the same grown by the line before (``a``) and after (``b``), -1 for none."""
    starts, ends, hashes = words(data, LINE, EXACT)
    first, last = chunks_of(hashes, window, every)
    n, final = len(first), len(hashes) - 1
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, max(final, 0))
    none = np.full(n, -1, np.int64)
    return {
        "line": first, "n_lines": last - first + 1, "hash": rolled(hashes, first, last), "start": starts[first], "stop": ends[last],
        "a_start": np.where(first > 0, starts[before], none), "a_hash": rolled(hashes, before, last),
        "b_stop": np.where(last < final, ends[after], none), "b_hash": rolled(hashes, first, after),
    }


FIELDS = ("line", "n_lines", "hash", "start", "stop", "a_start", "a_hash", "b_stop", "b_hash")


def _chunker(window: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(1))
            found = [anchors(data[at[i] : at[i + 1]], window, every) for i in range(batch.num_rows)]
            at_row = pa.array(np.repeat(np.arange(len(found)), [len(f["line"]) for f in found]).astype(np.int64))
            columns = [pa.array(np.concatenate([f[name] for f in found] or [np.zeros(0)]).astype(np.int64)) for name in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at_row), batch.column(2).take(at_row), *columns], names=["doc_id", "text_key", *FIELDS])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, text_key, chunks) -> a row with its bytes for each of the chunks."""
    for batch in batches:
        data, at = raw(batch.column(1))
        row, start, stop, line, n_lines, key, part = [], [], [], [], [], [], []
        for i, chunks in enumerate(batch.column(3).to_pylist()):
            for c in chunks:
                row.append(i)
                start.append(c["start"])
                stop.append(c["stop"])
                line.append(c["line"])
                n_lines.append(c["n_lines"])
                key.append(c["hash"])
                part.append(data[at[i] + c["start"] : at[i] + c["stop"]].tobytes())
        at_row = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at_row), batch.column(2).take(at_row), *[pa.array(x, pa.int64()) for x in (start, stop, line, n_lines, key)], pa.array(part, pa.binary())], names=["doc_id", "text_key", "start", "stop", "line", "n_lines", "hash", "bytes"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, cuts) -> the text without the lines of the cuts, each with the line feed before it; cuts that share a line are one passage."""
    for batch in batches:
        data, at = raw(batch.column(1))
        texts, lines, gone, chunks = [], [], [], []
        for i, cuts in enumerate(batch.column(2).to_pylist()):
            text = data[at[i] : at[i + 1]]
            keep = np.ones(len(text), bool)
            for c in cuts or ():
                keep[max(0, c["start"] - 1) : c["stop"]] = False
            held = {n for c in cuts or () for n in range(c["line"], c["line"] + c["n_lines"])}
            texts.append(text[keep].tobytes().decode("utf-8"))
            lines.append(int((text == 10).sum()) + 1 if len(text) else 0)
            gone.append(len(held))
            chunks.append(sum(n - 1 not in held for n in held))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(chunks, pa.int64())], names=["doc_id", "text", "n_lines", "n_removed_lines", "n_removed_chunks"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row for every row of ``docs``: doc_id, the remaining text, n_lines, n_removed_lines, n_removed_chunks.

    Removed chunks are whole passages of two lines or more. A null text counts as
    empty. Equal rows (doc_id and text) are one document: two lines at the same place
    of theirs are one occurrence. Rows that share a doc_id but not the text are
    documents of their own, ordered by a hash of the text. A null doc_id is below all
    others. Empty lines between two lines belong to them and count as lines of the
    document; one after a passage stays. Texts of any length are read whole. Other
    columns are ignored; an empty table gives an empty result.

    Occurrences may overlap: of ``a``, ``a``, ``a`` in a row the second pair repeats
    the first, and its lines go. What is removed is judged by all occurrences, removed ones
    too, so a stretch whose first occurrence lies across a removed passage may be left
    nowhere as a whole, though a copy of each of its lines is. A repeated pair of
    lines is missed where neither line nor both make a chunk in two of its places.

    Only chunks' hashes and places are grouped; the bytes of repeated ones alone are
    moved, and the occurrences of a very frequent one are compared in as many tasks
    as their number asks for. Most documents of a large corpus have repeated lines, so
    the joins with texts are shuffled at every size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    place = f"doc_id {id_type}, text_key long, start long, stop long, line long, n_lines long, hash long"
    found = materialize(docs.mapInArrow(lean(_chunker(*CHUNKS)), f"doc_id {id_type}, text_key long, " + ", ".join(f"{name} long" for name in FIELDS)), "line-chunks")
    seeds = materialize(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeated-seeds")
    stretch = lambda line, n, h, start, stop: F.struct(*[F.expr(x).alias(name) for x, name in zip((start, stop, line, n, h), ("start", "stop", "line", "n_lines", "hash"), strict=True)])
    # a repeated chunk of several lines, and every repeated one grown by a line to either side
    grown = F.array(F.when(F.col("n_lines") > 1, stretch("line", "n_lines", "hash", "start", "stop")), F.when(F.col("a_start") >= 0, stretch("line - 1", "n_lines + 1", "a_hash", "a_start", "stop")), F.when(F.col("b_stop") >= 0, stretch("line", "n_lines + 1", "b_hash", "start", "b_stop")))
    rows = found.join(sized(seeds), "hash").select("doc_id", "text_key", F.explode(F.array_compact(grown)).alias("s")).select("doc_id", "text_key", "s.*")
    places = rows.distinct().withColumn("n_bytes", F.col("stop") - F.col("start"))
    key = ["hash", "n_bytes"]
    # a null doc_id sorts first in min over structs
    groups = materialize(places.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "start")).alias("first")).where("n > 1"), "repeated-chunks")
    hits = materialize(places.join(sized(groups), key), "chunk-places")
    owner = [F.col("doc_id").alias("owner"), F.col("text_key").alias("owner_key")]
    of_owner = F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("text_key") == F.col("owner_key"))
    wanted = hits.groupBy(*owner).agg(F.collect_list(F.struct("start", "stop", "line", "n_lines", "hash")).alias("chunks"))  # a document's own chunks
    cut = docs.join(materialize(wanted, "chunk-owners").hint("merge"), of_owner).select("doc_id", "text", "text_key", "chunks")
    cut = cut.mapInArrow(lean(_cut), f"{place}, bytes binary").withColumn("n_bytes", F.col("stop") - F.col("start"))
    cut = materialize(cut.join(sized(groups), key), "chunk-bytes").withColumn("salts", F.ceil(F.col("n") / GROUP).cast("int"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("start") == F.col("first.start"))
    firsts = cut.where(is_first).dropDuplicates(key).select(*key, F.col("bytes").alias("first_bytes"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    others = cut.where(~is_first).withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "start"), F.col("salts")).cast("int"))
    same = others.join(firsts.hint("merge"), [*key, "salt"]).where(F.col("bytes") == F.col("first_bytes"))
    per = same.select("doc_id", "text_key", "start", "stop", "line", "n_lines").distinct().groupBy(*owner).agg(F.collect_list(F.struct("start", "stop", "line", "n_lines")).alias("cuts"))
    final = docs.join(materialize(per, "chunk-cuts").hint("merge"), of_owner, "left").select("doc_id", "text", "cuts")
    return final.mapInArrow(lean(_remove), f"doc_id {id_type}, text string, n_lines long, n_removed_lines long, n_removed_chunks long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
