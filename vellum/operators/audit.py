"""The audit log's hash chain, and audits that compare what is with what is recorded."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
KEYS = ("format", "path", "prev_hash", "reason", "ts", "verb")


def line(prev: Column, path: Column, reason: Column, ts: Column, verb: Column) -> Column:
    """An entry as canonical JSON: keys in order, no blanks, values escaped; null as empty."""
    values = {"format": F.lit("v2"), "path": path, "prev_hash": prev, "reason": reason, "ts": ts, "verb": verb}
    return F.to_json(F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in values.items()]))


def build(entries: DataFrame, chain: str, seq: str) -> DataFrame:
    """(chain, seq, raw): each entry with the hash of the one before it, as an append would have written it.

    Appending is sequential within a chain; chains are independent. Entries need
    columns path, reason, ts and verb; a null counts as empty. A chain's entries meet
    in order in one task, which holds the last hash only. The JSON is that of sorted
    keys, no blanks and characters beyond ASCII as they are.
    """
    key = dict(entries.dtypes)[chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, GENESIS
        for batch in batches:
            out = []
            owners, numbers, *rest = (c.to_pylist() for c in batch.columns)
            for owner, *values in zip(owners, *rest, strict=True):
                if now != (owner,):
                    now, last = (owner,), GENESIS
                entry = dict(zip(("path", "reason", "ts", "verb"), (v or "" for v in values), strict=True)) | {"format": "v2", "prev_hash": last}
                out.append(json.dumps(entry, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
                last = hashlib.sha256(out[-1].encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(out, pa.string())], names=[chain, seq, "raw"])

    rows = entries.select(chain, F.col(seq).cast("long").alias(seq), *[F.col(c).cast("string").alias(c) for c in ("path", "reason", "ts", "verb")])
    return rows.repartition(chain).sortWithinPartitions(chain, seq).mapInArrow(run, f"{chain} {key}, {seq} long, raw string")


def rotate(lines: DataFrame, chain: str, seq: str, tail: int = 60) -> DataFrame:
    """Add ``segment`` and ``anchor``: the last ``tail`` entries of a chain stay live, the rest is archived.

    The anchor of a live segment is the hash of the last archived line, so that it is
    verified without the archive; that of an archive is the chain's own start.
    """
    place = F.row_number().over(Window.partitionBy(chain).orderBy(F.desc(seq)))
    rows = lines.withColumn("place", place)
    cut = rows.where(F.col("place") == tail + 1).select(chain, F.sha2("raw", 256).alias("cut"))
    live = F.col("place") <= tail
    out = rows.join(cut, chain, "left").withColumn("segment", F.when(live, "live").otherwise("archive"))
    return out.withColumn("anchor", F.when(live, F.coalesce("cut", F.lit(GENESIS))).otherwise(F.lit(GENESIS))).drop("place", "cut")


def verify_segments(lines: DataFrame, chain: str, seq: str) -> DataFrame:
    """``verify`` for rotated lines: each segment's first entry is held against its anchor."""
    before = F.lag(F.sha2("raw", 256)).over(Window.partitionBy(chain, "segment").orderBy(seq))
    return lines.withColumn("ok", F.coalesce(F.get_json_object("raw", "$.prev_hash") == F.coalesce(before, F.col("anchor")), F.lit(False)))


def verify(lines: DataFrame, chain: str, seq: str, anchor: str = GENESIS) -> DataFrame:
    """Add ``ok``: whether an entry holds the hash of the line before it; the first is held against the anchor."""
    before = F.lag(F.sha2("raw", 256)).over(Window.partitionBy(chain).orderBy(seq))
    return lines.withColumn("ok", F.coalesce(F.get_json_object("raw", "$.prev_hash") == F.coalesce(before, F.lit(anchor)), F.lit(False)))


def jsonl_error(raw: Column) -> Column:
    """Why a line is no valid entry: bad_json, not_object, keys, format or value_type; null if it is one."""
    kind = F.substring(F.ltrim(raw), 1, 1)
    keys = F.sort_array(F.json_object_keys(raw))
    values = F.from_json(raw, "map<string,variant>")
    wrong = F.exists(F.map_values(values), lambda v: F.schema_of_variant(v) != "STRING")
    return (
        F.when(F.try_parse_json(raw).isNull(), "bad_json")
        .when(kind != "{", "not_object")
        .when(~keys.eqNullSafe(F.array(*map(F.lit, KEYS))), "keys")
        .when(wrong, "value_type")
        .when(F.get_json_object(raw, "$.format") != "v2", "format")
    )


def unlogged(files: DataFrame, logged: DataFrame, path: str = "path") -> DataFrame:
    """Files whose path is logged neither in full nor by its last part."""
    bare = F.regexp_extract(path, r"([^/]+)$", 1)
    known = logged.select(F.col("path").alias("known")).distinct()
    return files.withColumn("bare", bare).join(known, F.col(path) == F.col("known"), "left_anti").join(known, F.col("bare") == F.col("known"), "left_anti").drop("bare")


def diff(expected: DataFrame, actual: DataFrame, key: str = "name", content: str = "content") -> DataFrame:
    """(key, outcome) over both sides: missing, extra, drift or aligned, by a hash of the content."""
    a = expected.select(key, F.sha2(content, 256).alias("want"))
    b = actual.select(key, F.sha2(content, 256).alias("have"))
    outcome = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "drift").otherwise("aligned")
    return a.join(b, key, "full_outer").select(key, outcome.alias("outcome"))


def foreign_key_faults(rows: DataFrame, key: str, of: DataFrame, to: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).join(of.select(F.col(to).alias(key)).distinct(), key, "left_anti")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def promotable(archived: Column, cadence: Column, age: Column, done_name: Column, least: int = 14) -> tuple[Column, Column]:
    """Whether a note may leave the working zone, and why; the first rule that applies decides."""
    known = cadence.isin("stable", "weekly", "monthly", "event-driven", "monthly-or-on-structural-change")
    operational = cadence.isin("per-session", "continuous", "append-only")
    reason = (
        F.when(archived, "archived_reference flag")
        .when(operational, F.concat(F.lit("cadence:"), cadence, F.lit(" (operational, not promotable)")))
        .when(age < least, F.format_string("only %dd old (threshold %dd)", age, F.lit(least)))
        .when(known, F.format_string("cadence:%s, %dd old", cadence, age))
        .when(done_name, F.format_string("done-prefix, %dd old", age))
        .otherwise(F.concat(F.lit("cadence:"), F.when(F.coalesce(cadence, F.lit("")) == "", "(unset)").otherwise(cadence), F.lit(", no rule matched")))
    )
    allowed = ~F.coalesce(archived, F.lit(False)) & ~F.coalesce(operational, F.lit(False)) & (age >= least) & (F.coalesce(known, F.lit(False)) | done_name)
    return allowed, reason


def orphan_action(kind: Column, age: Column) -> Column:
    """What to do with a note that nothing links to, by type and age in days."""
    old = lambda t, days: F.when((kind == t) & (age > days), "archive")
    return F.coalesce(old("meeting", 60), old("source", 120), old("person", 180), F.when(kind.isin("meeting", "source", "decision", "person", "company"), "link-from-moc"), F.when(kind == "project", "review"), F.lit("triage"))
