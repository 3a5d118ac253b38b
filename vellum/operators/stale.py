"""Stale citations: rules on superseded binaries and on what a note cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

CONFIDENCE = {"A.1": "HIGH", "A.2": "MEDIUM", "A.3": "MEDIUM", "B.1": "HIGH", "B.2": "HIGH", "B.3": "LOW", "C.1": "MEDIUM"}
ACTION = {"A.1": "update-citation", "A.2": "review", "A.3": "review", "B.1": "update-citation", "B.2": "update-citation", "B.3": "monitor", "C.1": "review"}


def _said(table: dict[str, str], rule: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), rule)


def hash_state(manifest: DataFrame) -> DataFrame:
    """(sha, superseded_by) of every committed file; superseded_by is the least hash of those that supersede it."""
    done = manifest.where("status = 'committed'")
    newer = done.select(F.explode("supersedes").alias("sha"), F.col("sha").alias("by")).groupBy("sha").agg(F.min("by").alias("superseded_by"))
    return done.select("sha").distinct().join(newer, "sha", "left")


def own_findings(notes: DataFrame, state: DataFrame) -> DataFrame:
    """Rules A.1 and A.2: the note's own binary is superseded, or is not in the manifest."""
    rows = notes.where("sha is not null").join(state.withColumn("known", F.lit(True)), "sha", "left")
    rule = F.when(F.col("superseded_by").isNotNull(), "A.1").when(F.col("known").isNull(), "A.2")
    return rows.select("note", rule.alias("rule"), F.col("sha").alias("about")).where("rule is not null")


def stem_latest(manifest: DataFrame) -> DataFrame:
    """(stem, latest_sha, latest_at): the newest committed file of each stem by its time of extraction; ties by hash. ``manifest``: sha, source_file, extracted_at, status."""
    rows = manifest.where("status = 'committed'").select(T.stem(F.col("source_file")).alias("stem"), "sha", "extracted_at").where("stem <> ''")
    last = rows.groupBy("stem").agg(F.max(F.struct("extracted_at", "sha")).alias("last"))
    return last.select("stem", F.col("last.sha").alias("latest_sha"), F.col("last.extracted_at").alias("latest_at"))


def stem_findings(notes: DataFrame, latest: DataFrame) -> DataFrame:
    """Rule A.3: a note without a hash of its own whose stem has a file extracted after the note. ``notes``: note, sha, source_file, extracted_at."""
    rows = notes.where("sha is null and source_file is not null").withColumn("stem", T.stem(F.col("source_file"))).join(latest, "stem")
    return rows.where("latest_at > extracted_at").select("note", F.lit("A.3").alias("rule"), F.col("stem").alias("about"))


def citation_findings(notes: DataFrame, citations: DataFrame) -> DataFrame:
    """Rules B.1 to B.3, the first that applies for each cited source: not latest, superseded, newer than the note.

    ``notes``: note, type, is_latest, superseded_date, last_updated. ``citations``: note,
    cited; repeated and self citations count once and not at all.
    """
    citer = notes.select("note", F.col("last_updated").alias("own_date"))
    cited = notes.where(F.col("type").isin("source", "decision")).select(F.col("note").alias("cited"), "is_latest", "superseded_date", "last_updated")
    rows = citations.where("note <> cited").distinct().join(cited, "cited").join(citer, "note")
    rule = F.when(F.col("is_latest").eqNullSafe(F.lit(False)), "B.1").when(F.col("superseded_date").isNotNull(), "B.2").when(F.col("last_updated") > F.col("own_date"), "B.3")
    return rows.select("note", rule.alias("rule"), F.col("cited").alias("about")).where("rule is not null")


def transitive_findings(citations: DataFrame, stems: DataFrame, state: DataFrame) -> DataFrame:
    """Rule C.1: a cited note was ingested from a binary that is superseded. ``stems``: cited, sha."""
    gone = stems.join(state.where("superseded_by is not null"), "sha").groupBy("cited").agg(F.min("superseded_by").alias("by"))
    return citations.distinct().join(gone, "cited").select("note", F.lit("C.1").alias("rule"), F.col("cited").alias("about"))


def rated(findings: DataFrame) -> DataFrame:
    """Each finding once, with its confidence and action."""
    return findings.distinct().withColumns({"confidence": _said(CONFIDENCE, F.col("rule")), "action": _said(ACTION, F.col("rule"))})


def suggestion(findings: DataFrame, high: int = 5, medium: int = 20) -> DataFrame:
    """Whether the counts call for a review: one row."""
    n_high, n_medium = F.count_if(F.col("confidence") == "HIGH"), F.count_if(F.col("confidence") == "MEDIUM")
    return findings.agg(n_high.alias("n_high"), n_medium.alias("n_medium"), ((n_high >= high) | (n_medium >= medium)).alias("suggest"))
