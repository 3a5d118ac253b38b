"""Dropped files to notes: dispatch by suffix, Markdown and plain text, quarantine; settings and eval records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.hygiene import merge_frontmatter
from vellum.sources.files import frontmatter

# What marks a note as ingestion's own output; which handler takes which suffix.
PROVENANCE = "ingestion-pipeline"
HANDLERS = {"md": "md", "markdown": "md", "txt": "txt", "html": "html", "htm": "html", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image"}


def handler(name: Column) -> Column:
    """The handler of a file by its suffix; null for a type that is not supported, the formats before OOXML among them."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in HANDLERS.items() for x in kv]), F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)))


def notes(files: DataFrame, computed: Column) -> DataFrame:
    """(name, handler, status, reason, top, warnings, body, text_sha256) of dropped ``files`` (name, text), Markdown and plain text.

    ``computed`` is the map of top-level values that the run works out. A file of an
    unsupported type, with frontmatter that cannot be read, or that is ingestion's own
    output goes to quarantine; one of another supported type waits for its extractor.
    """
    rows = files.select("*", handler(F.col("name")).alias("handler"), computed.alias("computed"))
    rows = rows.withColumn("parsed", F.when(F.col("handler") == "md", frontmatter(F.col("text"))))
    fields = F.coalesce("parsed.fields", F.create_map().cast("map<string,string>"))
    own = (fields["provenance"] == PROVENANCE) | (F.get_json_object(fields["pipeline"], "$.provenance") == PROVENANCE)
    reason = F.when(F.col("handler").isNull(), "unsupported_file_type").when(F.col("parsed.error").isNotNull(), "frontmatter_parse_error").when(F.coalesce(own, F.lit(False)), "already_ingested")
    plain = F.col("handler").isin("md", "txt")
    status = F.when(reason.isNotNull(), "quarantined").when(plain, "ingested").otherwise("pending")
    done = status == "ingested"
    more = F.when(F.col("handler") == "txt", F.create_map(F.lit("type"), F.lit("text-note"), F.lit("file_type"), F.lit("txt"))).otherwise(F.create_map().cast("map<string,string>"))
    defaults = F.map_filter(more, lambda k, v: ~F.array_contains(F.map_keys("computed"), k))
    merged = merge_frontmatter(fields, F.map_concat("computed", defaults))
    body = F.when(F.col("handler") == "md", F.col("parsed.body")).otherwise(F.col("text"))
    return rows.select(
        "name", "handler", status.alias("status"), reason.alias("reason"), F.when(done, merged["top"]).alias("top"), F.when(done, merged["warnings"]).alias("warnings"),
        F.when(done, body).alias("body"), F.when(done, T.sha256(T.normalize(F.coalesce(body, F.lit(""))))).alias("text_sha256"),
    )


def thresholds(contract: Column, defaults: dict[str, float]) -> Column:
    """A project's numbers over the defaults; a contract that is missing or cannot be read changes none, and keys without a default are left out."""
    given = F.coalesce(F.from_json(contract, "map<string,double>"), F.create_map().cast("map<string,double>"))
    keys = F.array(*map(F.lit, defaults))
    values = F.array(*[F.coalesce(F.try_element_at(given, F.lit(k)), F.lit(float(v))) for k, v in defaults.items()])
    return F.map_from_arrays(keys, values)


CANDIDATE = "array<struct<path:string,score:double,content:string>>"


def candidates(text: Column) -> Column:
    """Rerank input from inline JSON: an array of candidates; null if it is none."""
    return F.from_json(text, CANDIDATE)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(path, score, content) of candidate files, each one JSON list."""
    return spark.read.schema("path string, score double, content string").option("multiLine", True).json(path)


def run_record(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an evaluation run's JSON lists; a file that holds none is an error."""
    heads = spark.read.option("wholetext", True).text(path).where(~F.startswith(F.ltrim("value"), F.lit("[")))
    if heads.limit(1).count():
        raise ValueError(f"not a list of records: {path}")
    return spark.read.schema(schema).option("multiLine", True).json(path)
