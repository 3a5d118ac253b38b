"""Queries on saved views, bitemporal filters and schema lints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.operators import lint, views
from vellum.scratch import materialize
from vellum.session import table

TODAY = "2001-08-02"


def versions(spark, d):
    """Orders of a customer as versions of one document: each is superseded by the next."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("70 Decisions/order_"), k.cast("string"), F.lit(".md")).alias("path"), "o_orderkey", "o_custkey", day.alias("document_date"), F.lead(day).over(by).alias("superseded_date"),
        F.when(k % 11 == 0, None).otherwise(F.lead(day).over(by).isNull()).alias("is_latest_version"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, "").otherwise(F.concat(F.lit("v"), F.row_number().over(by).cast("string"))).alias("document_version"),
        F.col("o_orderstatus").alias("status"), F.element_at(F.array(*map(F.lit, ("source", "decision", "meeting", "concept", "person", "audit"))), (k % 6 + 1).cast("int")).alias("type"),
        F.round(F.col("o_totalprice") / 500000, 3).alias("confidence"), F.when(k % 4 == 0, "pending").when(k % 9 == 0, "unknown").alias("stale"), F.col("o_orderpriority").alias("tier"),
    )


V = """v AS (SELECT concat('70 Decisions/order_', o_orderkey, '.md') AS path, o_orderkey, o_custkey, o_orderdate::DATE AS document_date, lead(o_orderdate::DATE) OVER w AS superseded_date,
  CASE WHEN o_orderkey % 11 <> 0 THEN lead(o_orderdate) OVER w IS NULL END AS is_latest_version,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '' ELSE concat('v', row_number() OVER w) END AS document_version, o_orderstatus AS status,
  ['source', 'decision', 'meeting', 'concept', 'person', 'audit'][o_orderkey % 6 + 1] AS type, round(o_totalprice / 500000, 3) AS confidence,
  CASE WHEN o_orderkey % 4 = 0 THEN 'pending' WHEN o_orderkey % 9 = 0 THEN 'unknown' END AS stale, o_orderpriority AS tier
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""

BASE = {
    "filters": {"and": ['type != "audit"']},
    "views": [
        {"name": "open", "filters": {"and": [{"or": ['status == "O"', 'status == "P"']}, {"not": ['stale == "pending"']}, "confidence < 0.5"]}, "order": [{"property": "document_date", "direction": "DESC"}], "tiebreak": ["o_orderkey"]},
        {"name": "recent", "filters": {"and": ["is_latest_version != false"]}, "order": [{"property": "document_date", "direction": "DESC"}], "tiebreak": ["o_orderkey"], "limit": 25},
        {"name": "grouped", "filters": {"and": ['stale != ""', 'document_version != ""']}, "groupBy": {"property": "type"}, "order": [{"property": "confidence", "direction": "ASC"}], "tiebreak": ["o_orderkey"]},
    ],
}


def _view(name, *columns):
    return lambda spark, d: views.view(versions(spark, d), BASE, name).select(*columns)


def view_latest_only(spark, d):
    return views.latest_only(versions(spark, d)).select("o_orderkey", "o_custkey")


def view_as_of(spark, d):
    return views.as_of(versions(spark, d), "1998-06-01").select("o_orderkey", "o_custkey", "document_date")


def view_in_force(spark, d):
    return views.as_of(versions(spark, d).where("type = 'decision'"), "1999-01-01").groupBy("status").agg(F.count("*").alias("n"), F.min("document_date").alias("oldest"))


def view_version_chain(spark, d):
    v = versions(spark, d).where(views.compile_filter('document_version != ""'))
    return v.groupBy(F.when(F.col("superseded_date").isNull(), "current").otherwise("superseded").alias("part")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_chains"))


def view_low_confidence(spark, d):
    tree = {"and": [{"or": [f'type == "{t}"' for t in ("source", "decision", "meeting", "concept")]}, "confidence < 0.5", "is_latest_version == true"]}
    return versions(spark, d).where(views.compile_filter(tree)).select("o_orderkey", "confidence", (F.col("confidence") <= 0.2).alias("very_low"))


def view_open_items(spark, d):
    v = versions(spark, d).where(F.col("type").isin("source", "decision", "meeting", "concept") & F.col("status").isin("O", "P"))
    return v.groupBy("type", "status").agg(F.count("*").alias("n"), F.count_if(F.col("stale").isin("pending", "unknown")).alias("n_stale"))


def view_tier2(spark, d):
    return versions(spark, d).where(views.compile_filter({"and": ['tier == "2-HIGH"', 'status == "F"', 'stale == ""']})).select("o_orderkey")


def base_contract(spark, d):
    """Parts as base specs, kept as JSON in a table: what each asks of its notes, counted by contract."""
    k = F.col("p_partkey")
    clause = F.concat(F.lit('"type == \\"'), F.regexp_replace("p_brand", r"\W", "_"), F.lit('kind\\""'))
    filters = F.when(k % 3 == 0, clause).when(k % 3 == 1, F.concat(clause, F.lit(', "size < 9"'))).otherwise(F.lit('"status == \\"O\\""'))
    column = F.element_at(F.array(*map(F.lit, ("note.owner", "file.mtime", "due"))), (F.col("p_size") % 3 + 1).cast("int"))
    spec = F.when(k % 50 == 7, "no json").otherwise(F.concat(F.lit('{"filters": {"and": ['), filters, F.lit(']}, "views": [{"order": [{"property": "'), column, F.lit('"}]}]}')))
    specs = materialize(table(spark, d, "part").select(F.concat(F.lit("base_"), k.cast("string")).alias("base"), spec.alias("spec")), "base-specs")
    found = views.contracts(specs).select("base", F.array_join("required", ",").alias("required"), F.array_join("types", ",").alias("types"), "is_primary", "view_only")
    return found.groupBy("required", "types", "is_primary", "view_only").agg(F.count("*").alias("n"), F.min("base").alias("first"))


CONTRACT = """WITH p AS (SELECT concat('base_', p_partkey) AS base, p_partkey % 50 = 7 AS bad, p_partkey % 3 AS m, concat(regexp_replace(p_brand, '\\W', '_', 'g'), 'kind') AS t, ['owner', NULL, 'due'][p_size % 3 + 1] AS c FROM part),
r AS (SELECT base, CASE WHEN bad THEN '' ELSE array_to_string(list_sort(list_filter([c, CASE m WHEN 1 THEN 'size' WHEN 2 THEN 'status' END], lambda x: x IS NOT NULL)), ',') END AS required, CASE WHEN bad OR m = 2 THEN '' ELSE t END AS types, NOT bad AND m = 0 AS is_primary, bad OR m = 2 AS view_only FROM p)
SELECT required, types, is_primary, view_only, count(*) AS n, min(base) AS first FROM r GROUP BY ALL"""


def schema_required_keys(spark, d):
    required = {"source": ["document_version", "stale"], "decision": ["superseded_date", "document_version"], "person": ["confidence", "stale"]}
    return views.missing_keys(versions(spark, d), required)


ZONES = ("70 Decisions/", "00 Inbox/", "80 Daily/", "99 Workspace/", "50 Sources/00 Inbox/", "")
CLAIMED = ("evidence", " Inference ", "'hypothesis'", "guess", "", "EVIDENCE!")


def lint_vocab(spark, d):
    """Types, stale flags and claim types against their vocabularies, over zones that bind and zones that do not."""
    k = F.col("o_orderkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    notes = versions(spark, d).withColumn("path", F.concat(pick(ZONES, k % 37), k.cast("string"), F.lit(".md"))).withColumn("claim_type", F.when(k % 5 > 0, pick(CLAIMED, k % 41)))
    return lint.vocabulary(notes)


VOCAB = f"""WITH {V}, n AS (SELECT concat({list(ZONES)}[o_orderkey % 37 % 6 + 1], o_orderkey, '.md') AS path, o_orderkey % 37 % 6 AS zone, type, stale, o_orderkey % 5 = 0 AS silent, o_orderkey % 41 % 6 AS claim FROM v)
SELECT path, 'type_vocab' AS rule, 'violation' AS kind FROM n WHERE type = 'audit' AND zone IN (0, 4) UNION ALL SELECT path, 'stale_enum', 'violation' FROM n WHERE stale = 'unknown'
UNION ALL SELECT path, 'claim_type', 'violation' FROM n WHERE NOT silent AND claim IN (3, 5) UNION ALL SELECT path, 'claim_type', 'signal' FROM n WHERE silent AND type <> 'audit'"""


def lint_confidence(spark, d):
    raw = F.when(F.col("p_partkey") % 5 == 0, F.lit("abc")).when(F.col("p_partkey") % 5 == 1, F.lit(None)).when(F.col("p_partkey") % 5 == 2, F.lit("1.01")).otherwise(F.concat(F.lit("0."), F.col("p_size").cast("string")))
    rows = table(spark, d, "part").select("p_partkey", raw.alias("raw")).withColumn("value", F.expr("try_cast(raw AS double)"))
    rule = F.when(F.col("raw").isNull(), "pass").when(F.col("value").isNull(), "type").when((F.col("value") < 0) | (F.col("value") > 1), "range").otherwise("pass")
    return rows.groupBy(rule.alias("outcome")).agg(F.count("*").alias("n"))


def lint_bitemporal(spark, d):
    v = versions(spark, d).where("type in ('source', 'decision')")
    found = F.array(F.when(F.col("is_latest_version").isNull(), "missing_is_latest_version"), F.when(F.col("document_version").isNull(), "missing_document_version"), F.when(F.col("superseded_date") <= F.col("document_date"), "superseded_before_document"))
    return v.select("type", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule")).groupBy("type", "rule").agg(F.count("*").alias("n"))


def lint_meeting_date(spark, d):
    """Meetings whose file name begins with another day than their date; a name's impossible day is a fault of its own."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    prefix = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 1, F.lit("2001-02-30")).otherwise(F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 1), "yyyy-MM-dd"))
    from vellum.functions.dates import parse

    rows = o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.concat(prefix, F.lit("_sync.md")).alias("name")).withColumn("prefix", F.regexp_extract("name", r"^(\d{4}-\d{2}-\d{2})", 1))
    named = parse(F.col("prefix"))
    return rows.groupBy(F.when(named.isNull(), "invalid_prefix").when(named != F.col("day"), "mismatch").otherwise("match").alias("outcome")).agg(F.count("*").alias("n"))


QUERIES = {
    "view_latest_only": (view_latest_only, f"WITH {V} SELECT o_orderkey, o_custkey FROM v WHERE is_latest_version IS DISTINCT FROM false"),
    "view_as_of": (view_as_of, f"WITH {V} SELECT o_orderkey, o_custkey, document_date FROM v WHERE document_date <= DATE '1998-06-01' AND (superseded_date IS NULL OR superseded_date > DATE '1998-06-01')"),
    "view_in_force": (view_in_force, f"WITH {V} SELECT status, count(*) AS n, min(document_date) AS oldest FROM v WHERE type = 'decision' AND document_date <= DATE '1999-01-01' AND (superseded_date IS NULL OR superseded_date > DATE '1999-01-01') GROUP BY status"),
    "view_version_chain": (view_version_chain, f"WITH {V} SELECT CASE WHEN superseded_date IS NULL THEN 'current' ELSE 'superseded' END AS part, count(*) AS n, count(DISTINCT o_custkey) AS n_chains FROM v WHERE coalesce(document_version, '') <> '' GROUP BY 1"),
    "view_low_confidence": (view_low_confidence, f"WITH {V} SELECT o_orderkey, confidence, confidence <= 0.2 AS very_low FROM v WHERE type IN ('source', 'decision', 'meeting', 'concept') AND confidence < 0.5 AND is_latest_version"),
    "view_open_items": (view_open_items, f"WITH {V} SELECT type, status, count(*) AS n, count(*) FILTER (stale IN ('pending', 'unknown')) AS n_stale FROM v WHERE type IN ('source', 'decision', 'meeting', 'concept') AND status IN ('O', 'P') GROUP BY ALL"),
    "view_tier2": (view_tier2, f"WITH {V} SELECT o_orderkey FROM v WHERE tier = '2-HIGH' AND status = 'F' AND coalesce(stale, '') = ''"),
    "view_compiled_spec": (_view("open", "o_orderkey", "type", "document_date"), f"WITH {V} SELECT o_orderkey, type, document_date FROM v WHERE type <> 'audit' AND status IN ('O', 'P') AND coalesce(stale, '') <> 'pending' AND confidence < 0.5"),
    "view_recent_limit": (_view("recent", "o_orderkey", "document_date"), f"WITH {V} SELECT o_orderkey, document_date FROM v WHERE type <> 'audit' AND is_latest_version IS DISTINCT FROM false ORDER BY v.document_date DESC, v.o_orderkey LIMIT 25"),
    "view_group_by": (_view("grouped", "type", "o_orderkey", "confidence"), f"WITH {V} SELECT type, o_orderkey, confidence FROM v WHERE type <> 'audit' AND coalesce(stale, '') <> '' AND coalesce(document_version, '') <> ''"),
    "base_contract": (base_contract, CONTRACT),
    "schema_required_keys": (schema_required_keys, f"""WITH {V}, k AS (SELECT path, type, 'document_version' AS missing_key FROM v WHERE type IN ('source', 'decision') AND trim(coalesce(document_version, '')) = ''
UNION ALL SELECT path, type, 'stale' FROM v WHERE type IN ('source', 'person') AND stale IS NULL UNION ALL SELECT path, type, 'superseded_date' FROM v WHERE type = 'decision' AND superseded_date IS NULL) SELECT * FROM k"""),
    "lint_vocab": (lint_vocab, VOCAB),
    "lint_confidence": (lint_confidence, "WITH r AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN NULL WHEN 2 THEN '1.01' ELSE concat('0.', p_size) END AS raw FROM part) SELECT CASE WHEN raw IS NULL THEN 'pass' WHEN try_cast(raw AS DOUBLE) IS NULL THEN 'type' WHEN try_cast(raw AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'range' ELSE 'pass' END AS outcome, count(*) AS n FROM r GROUP BY 1"),
    "lint_bitemporal": (lint_bitemporal, f"WITH {V}, s AS (SELECT * FROM v WHERE type IN ('source', 'decision')), f AS (SELECT type, 'missing_is_latest_version' AS rule FROM s WHERE is_latest_version IS NULL UNION ALL SELECT type, 'missing_document_version' FROM s WHERE document_version IS NULL UNION ALL SELECT type, 'superseded_before_document' FROM s WHERE superseded_date <= document_date) SELECT type, rule, count(*) AS n FROM f GROUP BY ALL"),
    "lint_meeting_date": (lint_meeting_date, "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'invalid_prefix' ELSE 'mismatch' END AS outcome, count(*) AS n FROM orders GROUP BY 1"),
}
