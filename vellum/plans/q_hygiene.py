"""Queries on hygiene rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import dates
from vellum.operators import hygiene
from vellum.plans.q_views import TODAY
from vellum.session import table

DAY = "2024-01-31"


def _recommendations(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("emitted_at"), (k % 3 + 1).alias("tier"), F.when(k % 4 == 0, "DONE").otherwise("OPEN").alias("status"))


REC = f"r AS (SELECT event_id, user_id, (event_id % 3 + 1)::INT AS tier, CASE WHEN event_id % 4 = 0 THEN 'DONE' ELSE 'OPEN' END AS status, (ts::DATE + CASE event_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 14 ELSE 30 END)::DATE AS expires_at FROM events), x AS (SELECT *, status = 'OPEN' AND expires_at < DATE '{DAY}' AS expired FROM r)"


def recommendation_expiry(spark, d):
    return hygiene.expiry(_recommendations(spark, d), DAY).groupBy("tier", "status", "expired", "place").agg(F.count("*").alias("n"), F.min("expires_at").alias("first_expiry"))


def backpressure(spark, d):
    open_rows = _recommendations(spark, d).groupBy("user_id").agg(F.count_if(F.col("status") == "OPEN").alias("n_open"))
    return open_rows.withColumn("decision", hygiene.backpressure(F.col("n_open")))


def freshness_cadence(spark, d):
    cadence = F.element_at(F.array(*map(F.lit, ("weekly", "monthly", "stable", "event-driven"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    age = dates.age_days(F.col("o_orderdate").cast("date"), TODAY)
    rows = table(spark, d, "orders").select("o_orderkey", cadence.alias("cadence"), age.alias("age"))
    return rows.select("o_orderkey", "cadence", "age", hygiene.cadence_stale(F.col("cadence"), F.col("age")).alias("stale"))


CADENCE = f"WITH r AS (SELECT o_orderkey, ['weekly', 'monthly', 'stable', 'event-driven'][o_orderkey % 4 + 1] AS cadence, date_diff('day', o_orderdate::DATE, DATE '{TODAY}')::INT AS age FROM orders) SELECT *, coalesce(age > CASE cadence WHEN 'weekly' THEN 7 WHEN 'monthly' THEN 30 END, false) AS stale FROM r"


def size_flags(spark, d):
    size = F.octet_length("text")
    rows = table(spark, d, "documents").select("doc_id", size.alias("bytes")).where("bytes > 4096")
    return rows.withColumn("flag", F.when(F.col("bytes") > 16384, "rotate").when(F.col("bytes") > 8192, "large").otherwise("watch"))


def strike_rule(spark, d):
    """Customers' orders at which three in a row are over a bound."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return hygiene.strike(rows, F.col("o_totalprice") > 250000, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


STRIKE = "WITH w AS (SELECT o_custkey, o_orderkey, min((o_totalprice > 250000)::INT) OVER x AS m, count(*) OVER x AS n FROM orders WINDOW x AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT o_custkey, o_orderkey FROM w WHERE m = 1 AND n = 3"


def section_parse(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber").alias("place"), F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("## "), F.col("l_returnflag"))).otherwise(F.lit("a line")).alias("text"))
    return hygiene.sections(rows, "l_orderkey", "place", "text")


SECTIONS = "WITH l AS (SELECT l_orderkey, CASE WHEN l_partkey % 5 = 0 THEN l_returnflag END AS h, l_shipdate, l_partkey, l_suppkey, l_linenumber FROM lineitem), w AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM l) SELECT l_orderkey, header, count(*) AS n_lines FROM w WHERE header IS NOT NULL AND h IS NULL GROUP BY ALL"

ZONES = {"20 Companies": ["the", "and"], "40 Meetings": ["der", "und", "ein"], "60 Concepts": ["de", "que", "un"]}


def zone_classify(spark, d):
    return table(spark, d, "documents").select("doc_id", hygiene.zone_of(F.col("text"), ZONES).alias("zone"))


ZONE = "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents), s AS (SELECT doc_id, " + ", ".join(f"len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in words)}))) AS s{i}" for i, words in enumerate(ZONES.values())) + " FROM t), g AS (SELECT *, greatest(s0, s1, s2) AS m FROM s) SELECT doc_id, CASE WHEN m < 2 OR (s0 = m)::INT + (s1 = m)::INT + (s2 = m)::INT > 1 THEN '00 Inbox' WHEN s0 = m THEN '20 Companies' WHEN s1 = m THEN '40 Meetings' ELSE '60 Concepts' END AS zone FROM g"


def save_downgrade(spark, d):
    n = F.size(F.split(F.trim("text"), r"\s+"))
    kind = F.when(F.col("doc_id") % 5 == 0, "decision").otherwise("source")
    why = hygiene.downgrade(n, kind, F.contains("text", F.lit("!!")), F.col("doc_id") % 3 != 0)
    return table(spark, d, "documents").groupBy(F.coalesce(why, F.lit("keep")).alias("outcome")).agg(F.count("*").alias("n"))


DOWNGRADE = "SELECT CASE WHEN contains(text, '!!') THEN 'uncertain' WHEN len(regexp_split_to_array(trim(text), '\\s+')) < 200 AND doc_id % 5 <> 0 THEN 'short' WHEN doc_id % 3 = 0 THEN 'no_entity' ELSE 'keep' END AS outcome, count(*) AS n FROM documents GROUP BY 1"


def catalog_recency(spark, d):
    """The catalogue's head: one line a note, by zone, last touched first."""
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("zone"), F.col("o_orderdate").cast("date").alias("touched"), "o_orderkey")
    return rows.orderBy("zone", F.desc("touched"), "o_orderkey").limit(100)


def header_infer(spark, d):
    """Header kinds of sheets whose first row mixes strings, numbers, formulas and empty cells."""
    k = F.col("p_partkey")
    cell = lambda text, kind: F.struct(text.cast("string").alias("text"), F.lit(kind).alias("kind"))
    second = F.when(k % 4 == 0, cell(F.lit("Size"), "string")).when(k % 4 == 1, cell(F.col("p_size"), "number")).when(k % 4 == 2, cell(F.lit("=A1"), "string")).otherwise(cell(F.lit(None), "empty"))
    first = F.when(k % 12 == 3, cell(F.lit(None), "empty")).otherwise(cell(F.col("p_name"), "string"))
    return table(spark, d, "part").select("p_partkey", hygiene.header_row(F.array(first, second)).alias("header"), hygiene.column_letter(F.col("p_size").cast("int")).alias("letter"))


HEADER = "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 2) OR p_partkey % 12 = 3 THEN 'letters' ELSE 'real' END AS header, CASE WHEN p_size > 26 THEN concat(chr(64 + ((p_size - 1) // 26)::INT), chr(65 + (p_size - 1) % 26)) ELSE chr(64 + p_size) END AS letter FROM part"


def frontmatter_merge(spark, d):
    k = F.col("c_custkey")
    none = F.create_map().cast("map<string,string>")
    user = F.map_concat(
        F.create_map(F.lit("title"), F.when(k % 2 == 0, F.col("c_name")), F.lit("note"), F.col("c_nationkey").cast("string")),
        F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("tags"), F.concat(F.lit("own,"), F.col("c_mktsegment")))).otherwise(none),
        F.when(k % 3 == 0, F.create_map(F.lit("pipeline"), F.lit("edited"))).otherwise(none),
    )
    computed = F.create_map(F.lit("title"), F.lit("Computed"), F.lit("tags"), F.lit("auto"), F.lit("type"), F.lit("source"), F.lit("zone"), F.lit("dropped"))
    rows = table(spark, d, "customer").select("c_custkey", hygiene.merge_frontmatter(user, computed).alias("m"))
    get = lambda name: F.col("m.top")[name].alias(name)
    return rows.select("c_custkey", get("title"), get("tags"), get("type"), get("note"), F.array_join(F.array_sort(F.map_keys("m.top")), ",").alias("keys"), F.array_join("m.warnings", ",").alias("warnings"))


MERGE = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Computed' END AS title, CASE WHEN c_acctbal > 0 THEN concat('own,', c_mktsegment) ELSE 'auto' END AS tags, 'source' AS type, c_nationkey::VARCHAR AS note, 'note,tags,title,type' AS keys, CASE WHEN c_custkey % 3 = 0 THEN 'user_edit_in_pipeline_ns' ELSE '' END AS warnings FROM customer"


def scaffold(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").groupBy(hygiene.scaffold_path(c % 2 == 0, c % 3 == 0, c % 5 == 0).alias("path")).agg(F.count("*").alias("n"))


def path_rewrite(spark, d):
    """A move of one file in all texts that mention its path or name, which may also stand inside other names."""
    text = F.concat(F.lit("see "), F.col("p_type"), F.lit("/"), F.col("p_name"), F.lit(" and "), F.col("p_name"), F.lit(", not x"), F.col("p_name"), F.lit(" nor "), F.col("p_name"), F.lit("-old"))
    rows = table(spark, d, "part").select("p_partkey", text.alias("before"))
    return rows.withColumn("after", hygiene.rewritten(F.col("before"), [("ECONOMY/small ring", "_archive/$1/small_ring")])).where("before <> after")


REWRITE = "WITH b AS (SELECT p_partkey, concat('see ', p_type, '/', p_name, ' and ', p_name, ', not x', p_name, ' nor ', p_name, '-old') AS before FROM part), f AS (SELECT *, regexp_replace(before, '(^|[^A-Za-z0-9_/-])ECONOMY/small ring($|[^A-Za-z0-9_-])', '\\1_archive/$1/small_ring\\2', 'g') AS f FROM b), a AS (SELECT p_partkey, before, regexp_replace(f, '(^|[^A-Za-z0-9_/-])small ring($|[^A-Za-z0-9_-])', '\\1small_ring\\2', 'g') AS after FROM f) SELECT * FROM a WHERE before <> after"


def bulk_reconcile(spark, d):
    """Unlogged writes an hour and kind: one line each, or a summary beyond twenty."""
    rows = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    return rows.withColumn("mode", F.when(F.col("n") > 20, "summary").otherwise("each"))


def index_age(spark, d):
    """Whole days since each source's newest entry, and whether the index is to be rebuilt."""
    rows = table(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("last"))
    age = F.floor((F.unix_timestamp(F.lit("2024-02-10 00:00:00").cast("timestamp")) - F.unix_timestamp("last")) / 86400)
    return rows.select("event_type", age.alias("age_days"), (age > 7).alias("drift"))


def dimension_check(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("v"), "label").groupBy("label").agg(F.count_if(F.size("v") == 64).alias("n_good"), F.count_if(F.size("v") != 64).alias("n_rejected"))


QUERIES = {
    "recommendation_expiry": (recommendation_expiry, f"WITH {REC} SELECT tier::BIGINT AS tier, status, expired, CASE WHEN tier = 3 THEN 0 WHEN expired THEN 1 ELSE 2 END AS place, count(*) AS n, min(expires_at) AS first_expiry FROM x GROUP BY ALL"),
    "backpressure": (backpressure, f"WITH {REC} SELECT user_id, count(*) FILTER (status = 'OPEN') AS n_open, CASE WHEN count(*) FILTER (status = 'OPEN') > 20 THEN 'suppress' ELSE 'emit' END AS decision FROM r GROUP BY user_id"),
    "freshness_cadence": (freshness_cadence, CADENCE),
    "size_flags": (size_flags, "WITH r AS (SELECT doc_id, strlen(text)::INT AS bytes FROM documents) SELECT *, CASE WHEN bytes > 16384 THEN 'rotate' WHEN bytes > 8192 THEN 'large' ELSE 'watch' END AS flag FROM r WHERE bytes > 4096"),
    "strike_rule": (strike_rule, STRIKE),
    "section_parse": (section_parse, SECTIONS),
    "zone_classify": (zone_classify, ZONE),
    "save_downgrade": (save_downgrade, DOWNGRADE),
    "catalog_recency": (catalog_recency, "SELECT o_orderpriority AS zone, o_orderdate::DATE AS touched, o_orderkey FROM orders ORDER BY 1, 2 DESC, 3 LIMIT 100"),
    "header_infer": (header_infer, HEADER),
    "frontmatter_merge": (frontmatter_merge, MERGE),
    "scaffold": (scaffold, "SELECT CASE WHEN c_custkey % 2 <> 0 THEN 'a' WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'c' ELSE 'b' END AS path, count(*) AS n FROM customer GROUP BY 1"),
    "path_rewrite": (path_rewrite, REWRITE),
    "bulk_reconcile": (bulk_reconcile, "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CASE WHEN count(*) > 20 THEN 'summary' ELSE 'each' END AS mode FROM events GROUP BY 1, 2"),
    "index_age": (index_age, "SELECT event_type, floor((epoch(TIMESTAMP '2024-02-10') - floor(epoch(max(ts)))) / 86400)::BIGINT AS age_days, floor((epoch(TIMESTAMP '2024-02-10') - floor(epoch(max(ts)))) / 86400) > 7 AS drift FROM events GROUP BY 1"),
    "dimension_check": (dimension_check, "SELECT label, count(*) FILTER (vec_id % 9 <> 0) AS n_good, count(*) FILTER (vec_id % 9 = 0) AS n_rejected FROM embeddings GROUP BY label"),
}
