"""Scans: notes with frontmatter, manifest lines, vector stores, base specs, prose."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vellum.scratch import small_batches

# Folders that no scan enters, besides dotted ones, and the zones that hold typed notes.
SKIPPED = ("__pycache__", "node_modules", "_archive", "_archives", "archive", "archives", "Templates", "_skill_packages", "_skill_resources", "_log_archive", "_session_handoff_archive", "_auto_writes_archive", "_ingestion_pipeline", "_drop", "_originals")
TYPED_ZONES = ("10 People", "20 Companies", "30 Projects", "40 Meetings", "50 Sources", "60 Concepts", "70 Decisions")

MANIFEST = (
    "run_id string, sha256 string, source_filename string, supersession_stem string, extracted_at timestamp, status string, md_path string, original_path string, "
    "quarantine_reason string, supersedes array<string>, committed_at timestamp, manifest_offset long, text_sha256 string, corrupt string"
)


def _below(root: str, path: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(path, r"^[a-z]+:/*", "/"), "%20", " ")
    return F.regexp_replace(plain, "^" + reduce(lambda s, c: s.replace(c, "\\" + c), ".()+", root.rstrip("/")) + "/", "")


def notes(spark: SparkSession, root: str, zones: tuple[str, ...] = (), skipped: tuple[str, ...] = SKIPPED, head: int | None = None) -> DataFrame:
    """(path, zone, basename, mtime, size, text) of every Markdown file under ``root``, without skipped and dotted folders and folder notes.

    ``zones`` keeps those first folders only; ``head`` keeps so many characters of a text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    path = _below(root, F.col("path"))
    parts = F.split(path, "/")
    text = F.decode("content", "UTF-8")
    rows = files.select(
        path.alias("path"), F.when(F.size(parts) > 1, parts[0]).alias("zone"), F.regexp_extract(path, r"([^/]+)\.md$", 1).alias("basename"),
        F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), (F.substring(text, 1, head) if head else text).alias("text"), F.slice(parts, 1, F.size(parts) - 1).alias("folders"),
    )
    rows = rows.where(~F.arrays_overlap("folders", F.array(*map(F.lit, skipped))) & ~F.exists("folders", lambda f: F.startswith(f, F.lit("."))) & (F.col("basename") != "folder"))
    if zones:
        rows = rows.where(F.col("zone").isin(*zones))
    return rows.drop("folders")


def _frontmatter(text: str | None) -> tuple[dict[str, str] | None, str | None, str]:
    import yaml

    text = text or ""
    if not text.startswith("---\n"):
        return {}, None, text
    end = text.find("\n---", 3)
    if end < 0:
        return None, "unterminated_frontmatter", text
    body = text[end + 4 :].lstrip("\n")
    try:
        found = yaml.safe_load(text[4 : end + 1])
    except yaml.YAMLError:
        return None, "yaml_error", body
    if found is None:
        return {}, None, body
    if not isinstance(found, dict):
        return None, "frontmatter_not_mapping", body
    import json

    return {str(k): v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False) for k, v in found.items() if v is not None}, None, body


FRONTMATTER = "struct<fields:map<string,string>,error:string,body:string>"


def frontmatter(text: Column) -> Column:
    """Frontmatter as a map (nested values as JSON), why it is none, and the body; in Arrow batches."""
    small_batches(SparkSession.active())

    @pandas_udf(FRONTMATTER)
    def parse(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([_frontmatter(t) for t in batch], columns=["fields", "error", "body"])

    return parse(text)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of the manifest; what is no JSON is kept in ``corrupt`` to be counted."""
    return spark.read.schema(MANIFEST).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


def vectors(spark: SparkSession, path: str, model: str, dim: int) -> DataFrame:
    """(key, path, vector) of a store whose files are JSON objects without braces: source keys of one model and length."""
    files = spark.read.option("wholetext", True).text(path)
    body = F.concat(F.lit("{"), F.regexp_replace(F.trim(F.regexp_replace("value", r"\s+$", "")), r",\s*$", ""), F.lit("}"))
    entry = "map<string,struct<path:string,embeddings:map<string,struct<vec:array<float>>>>>"
    rows = files.select(F.explode(F.from_json(body, entry)).alias("key", "e")).where(F.startswith("key", F.lit("smart_sources:")))
    rows = rows.select("key", F.coalesce("e.path", F.regexp_replace("key", "^smart_sources:", "")).alias("path"), F.col("e.embeddings")[model]["vec"].alias("vector"))
    return rows.where(F.size("vector") == dim)


def bases(spark: SparkSession, path: str) -> dict[str, dict]:
    """Base specs by name; a few files of settings, read on the driver. A malformed one is an error."""
    import yaml

    found = {}
    for row in spark.read.format("binaryFile").option("pathGlobFilter", "*.base").option("recursiveFileLookup", True).load(path).select("path", "content").collect():
        spec = yaml.safe_load(bytes(row.content).decode())
        if not isinstance(spec, dict) or not isinstance(spec.get("views", []), list):
            raise ValueError(f"not a base: {row.path}")
        found[row.path.rpartition("/")[2].replace("%20", " ").removesuffix(".base")] = spec
    return found


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of Markdown and text files, without frontmatter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").load(root)
    text = F.decode("content", "UTF-8")
    return files.select("path", F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "").alias("text"))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_rejected(files: DataFrame, path: str, reason: str = "reason", day: str = "day") -> None:
    """Rejected and quarantined files by day, under a name with eight digits of their hash."""
    named = files.withColumn("name", F.concat(F.substring("sha256", 1, 8), F.lit("_"), F.col("name")))
    named.write.mode("append").partitionBy(day).parquet(path)


def rendered(note: DataFrame, fields: str = "fields", body: str = "body", source: str = "source_file") -> DataFrame:
    """Notes as they are written: frontmatter with its keys in order, a link to the original, the body."""
    keys = F.array_sort(F.map_keys(fields))
    lines = F.transform(keys, lambda k: F.concat(k, F.lit(": "), F.element_at(F.col(fields), k)))
    text = F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n[Open original]("), F.col(source), F.lit(")\n\n"), F.col(body))
    return note.withColumn("rendered", text)
