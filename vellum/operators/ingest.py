"""Ingestion: tiers of deduplication, supersession, the manifest's state, run limits."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.scratch import materialize


def tiered_dedup(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sha256, text_sha256, status) of each row: exact_duplicate, content_duplicate or ingested.

    Rows arrive in the order of their key. A row is an exact duplicate of an earlier
    one with the same bytes, a content duplicate of an earlier one with the same
    normalised text; an empty normalised text matches none. Both firsts come from
    aggregations of hashes, so no group of copies is gathered in a task.
    """
    text = F.coalesce("text", F.lit(""))
    empty = hashlib.sha256(b"").hexdigest()
    plain = T.sha256(T.normalize(text))
    # three uses of two hashes a row, so they are written and the texts are read once
    hashed = materialize(docs.select(key, T.sha256(text).alias("sha256"), F.nullif(plain, F.lit(empty)).alias("text_sha256")), "hashes")
    first = hashed.groupBy("sha256").agg(F.min(key).alias("first_sha"))
    plain = hashed.where("text_sha256 is not null").groupBy("text_sha256").agg(F.min(key).alias("first_text"))
    joined = hashed.join(first, "sha256").join(plain, "text_sha256", "left")
    status = F.when(F.col(key) > F.col("first_sha"), "exact_duplicate").when(F.col(key) > F.col("first_text"), "content_duplicate").otherwise("ingested")
    return joined.select(key, "sha256", "text_sha256", status.alias("status"))


def current_state(manifest: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each file in a run; an aggregation, since only the greatest row counts."""
    rest = [c for c in manifest.columns if c not in keys]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("last")
    return manifest.groupBy(*keys).agg(last).select(*keys, *[f"last.{c}" for c in rest])


def unresolved(manifest: DataFrame) -> DataFrame:
    """Intents without a later commit, quarantine or rollback of the same run and file."""
    done = manifest.where(F.col("status").isin("committed", "quarantined", "rolled_back")).select("run_id", "sha256").distinct()
    return manifest.where("status = 'intent'").join(done, ["run_id", "sha256"], "left_anti")


def supersession(files: DataFrame, stem: str, at: str, key: str, days: int = 90, beyond: bool = False) -> DataFrame:
    """Earlier rows of the same stem within ``days`` before each row, or those before that; pairs, newest first.

    Without a date a row counts as always in the window. Within the window a row meets
    only those of its stem's own span of ``days`` and of the one before, so a stem with
    many rows makes no more pairs than lie near each other and is spread by span.
    Beyond it every older pair is a result.
    """
    a = files.select(F.col(stem).alias("stem"), F.col(key).alias("new_key"), F.col(at).alias("new_at"))
    b = files.select(F.col(stem).alias("stem"), F.col(key).alias("old_key"), F.col(at).alias("old_at"))
    gap = F.datediff("new_at", "old_at")
    span = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    other = F.col("new_key") != F.col("old_key")
    if beyond:
        return a.join(b, "stem").where(other & (F.col("old_at") < F.col("new_at")) & (gap > days)).withColumn("gap_days", gap)
    near = a.withColumn("span", F.explode(F.array(span("new_at"), span("new_at") - 1))).join(b.where("old_at is not null").withColumn("span", span("old_at")), ["stem", "span"]).drop("span")
    near = near.where(other & (F.col("old_at") < F.col("new_at")) & (gap <= days))
    dateless = a.join(b.where("old_at is null"), "stem").where(other)
    return near.unionByName(dateless.select(near.columns)).withColumn("gap_days", gap)


def run_cut(files: DataFrame, run: str, order: list[str], size: str, limit: int) -> DataFrame:
    """Mark files of a run as processed or skipped: the one that crosses the limit still counts as processed."""
    before = F.sum(size).over(Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("state", F.when(F.coalesce(before, F.lit(0)) >= limit, "skipped").otherwise("processed"))


def recovered(manifest: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows that a recovery appends: an unresolved intent whose original and note are both staged is committed, with its text's hash; others are skipped with the reason.

    ``staged``: run_id, sha256, has_original, has_note.
    """
    rows = unresolved(manifest).join(staged, ["run_id", "sha256"], "left")
    reason = F.when(~F.coalesce("has_original", F.lit(False)), "staged binary missing").when(~F.coalesce("has_note", F.lit(False)), "staged note missing")
    kept = [c for c in manifest.columns if c != "status"]
    return rows.select(*kept, F.when(reason.isNull(), "committed").otherwise("skipped").alias("status"), reason.alias("reason"))


def rolled_back(manifest: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Rows that a rollback of a run appends: one for each file whose last state in the run is committed, so it does not repeat."""
    now = current_state(manifest.where(F.col("run_id") == run), ["run_id", "sha256"], order)
    return now.where("status = 'committed'").withColumn("status", F.lit("rolled_back"))


def superseded_versions(files: DataFrame, name: str = "name") -> DataFrame:
    """All but the last version of each stem, for names like ``stem_v2.md``; minor versions tie, then the name decides."""
    parts = files.select(name, F.regexp_extract(name, r"^(.+)_v(\d+)(?:\.\d+)?\.md$", 1).alias("stem"), F.regexp_extract(name, r"^(.+)_v(\d+)(?:\.\d+)?\.md$", 2).alias("v")).where("stem <> ''")
    parts = parts.select(name, "stem", F.col("v").cast("int").alias("version"))
    last = parts.groupBy("stem").agg(F.max(F.struct("version", name)).alias("last"))
    return parts.join(last, "stem").where(F.struct("version", name) != F.col("last")).select(name, "stem", "version", F.col("last.version").alias("latest_version"))
