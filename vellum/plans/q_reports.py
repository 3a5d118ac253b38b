"""Queries on what runs leave behind and take in: reports, logs, queues, extraction, recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import ingest, reports
from vellum.plans.q_graph import FINDINGS, _findings
from vellum.plans.q_ingest import MANIFEST, NORMAL, _manifest
from vellum.plans.q_retrieval import PAIRS, _pairs
from vellum.session import table
from vellum.sources import extract

DAY = "2024-01-31"


def report_findings(spark, d):
    """The stale lint's report: findings by rule, twenty lines each."""
    rows = _findings(spark, d).select("rule", F.concat(F.lit("`"), F.lpad(F.col("note").cast("string"), 9, "0"), F.lit("` "), "action", F.lit(" "), F.coalesce("about", F.lit(""))).alias("line"))
    return reports.report(rows, "Stale citations", "rule", "line")


REPORT = (
    FINDINGS
    + """, l AS (SELECT rule, concat('`', lpad(note::VARCHAR, 9, '0'), '` ', action, ' ', coalesce(about, '')) AS line FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY line) AS k, count(*) OVER (PARTITION BY rule) AS n FROM l),
s AS (SELECT rule, max(n) AS n, concat('## ', rule, ' (', max(n), ')', chr(10), chr(10), string_agg(concat('- ', line), chr(10) ORDER BY line) FILTER (k <= 20), CASE WHEN max(n) > 20 THEN concat(chr(10), '- … and ', max(n) - 20, ' more') ELSE '' END) AS section FROM k GROUP BY rule)
SELECT concat('# Stale citations', chr(10), chr(10), sum(n)::BIGINT, ' finding(s).', chr(10), chr(10), string_agg(section, chr(10) || chr(10) ORDER BY rule), chr(10)) AS text FROM s"""
)


def json_report(spark, d):
    rows = _findings(spark, d).groupBy("rule", "action").agg(F.count("*").alias("n"))
    return reports.json_lines(rows)


def _results(spark, d):
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("committed", "ingested", "quarantined", "quarantined", "rolled_back", "rejected", "intent", "skipped")]), F.col("status"))
    return _manifest(spark, d).select("run_id", F.concat(F.lit("file "), "sha256").alias("name"), "event_id", status.alias("status"))


def run_logs(spark, d):
    return reports.run_log(_results(spark, d), DAY)


RUN_LOGS = f"""WITH {MANIFEST}, c AS (SELECT run_id, count(*) AS n, count(*) FILTER (status = 'committed') AS i, count(*) FILTER (status = 'quarantined') AS q, count(*) FILTER (status = 'intent') AS s FROM m GROUP BY 1)
SELECT run_id, concat('### Ingestion `', run_id, '`', chr(10), n, ' file(s) scanned: **', i, '** ingested, **', q, '** quarantined, **', s, '** skipped.') AS daily, concat('{DAY} | note | ingestion | pipeline run ', run_id, ': ', i, ' ingested, ', q, ' quarantined') AS auto_write FROM c"""


def file_table(spark, d):
    rows = _results(spark, d).withColumn("reason", F.when(F.col("status") == "rejected", "out_of_scope"))
    return reports.file_table(rows, "run_id", "name", "status", "reason").groupBy("run_id", "line").agg(F.count("*").alias("n"))


FILE_TABLE = f"WITH {MANIFEST} SELECT run_id, concat('| `file ', sha256, '` | ', CASE status WHEN 'committed' THEN 'ingested' WHEN 'quarantined' THEN 'quarantined' WHEN 'rolled_back' THEN 'rejected' ELSE 'skipped' END, ' | ', CASE status WHEN 'rolled_back' THEN 'out_of_scope' ELSE '' END, ' |') AS line, count(*) AS n FROM m GROUP BY ALL"


def supersession_queue(spark, d):
    files = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("stem"), F.col("o_orderdate").cast("date").alias("at"))
    pairs = ingest.supersession(files, "stem", "at", "o_orderkey", 90)
    return reports.supersession_blocks(pairs.withColumn("sha256", T.sha256(F.col("old_key").cast("string"))))


QUEUE = """WITH p AS (SELECT a.o_orderkey AS new_key, b.o_orderkey AS old_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate::DATE < a.o_orderdate::DATE AND date_diff('day', b.o_orderdate::DATE, a.o_orderdate::DATE) <= 90)
SELECT new_key, concat('## Supersession', chr(10), chr(10), '**New file:** `', new_key, '`', chr(10), chr(10), string_agg(concat('- `', old_key, '` (SHA: `', left(sha256(old_key::VARCHAR), 16), '…`)'), chr(10) ORDER BY old_key)) AS block FROM p GROUP BY new_key"""


def soft_duplicate_queue(spark, d):
    p = _pairs(spark, d, 0.4)
    both = p.select(F.col("a").alias("key"), F.col("b").alias("other"), "score").union(p.select("b", "a", "score"))
    return reports.soft_duplicate_blocks(both, 0.45)


SOFT = "WITH " + PAIRS % 0.4 + """, x AS (SELECT a AS key, b::VARCHAR AS other, score FROM p UNION ALL SELECT b, a::VARCHAR, score FROM p)
SELECT key, concat('### Soft-duplicate candidate', chr(10), chr(10), '**New file:** `', key, '`', chr(10), format('**Top semantic score:** {:.4f}', max(score)), chr(10), chr(10), '| Score | Nearest neighbour |', chr(10), '|-------|-------------------|', chr(10), string_agg(format('| {:.4f} | `{}` |', score, other), chr(10) ORDER BY score DESC, other)) AS block FROM x GROUP BY key HAVING max(score) >= 0.45"""


def call_audit(spark, d):
    e = table(spark, d, "events").where("event_type in ('click', 'error')")
    k = F.get_json_object("props", "$.k").cast("int")
    return reports.call_audit(e.select(F.concat(F.lit("scan \""), k.cast("string"), F.lit("\".png")).alias("filename"), F.lit("reader").alias("model"), T.sha256(F.col("event_id").cast("string")).alias("sha256"), k.alias("tokens_in"), (k * 2).alias("tokens_out"), (F.col("event_type") == "click").alias("success"), F.when(F.col("event_type") == "error", "timeout").alias("error_code")))


CALLS = """WITH e AS (SELECT event_id, event_type, (props::JSON ->> 'k')::INT AS k FROM events WHERE event_type IN ('click', 'error'))
SELECT concat('{', CASE WHEN event_type = 'error' THEN '"error_code":"timeout",' ELSE '' END, '"filename":"scan \\"', k, '\\".png","model":"reader","sha256":"', sha256(event_id::VARCHAR), '","success":', event_type = 'click', ',"tokens_in":', k, ',"tokens_out":', k * 2, '}') AS line FROM e"""


def registry_upsert(spark, d):
    """A registry of plans with the rows of one status replaced."""
    held = table(spark, d, "orders").select("o_orderkey", F.lit("old").alias("state"), "o_totalprice")
    new = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.lit("new").alias("state"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return reports.upsert(reports.upsert(held, new, "o_orderkey"), new, "o_orderkey").groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


UPSERT = "SELECT CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'old' END AS state, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'P' THEN 2 * o_totalprice ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1"


def log_headers(spark, d):
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'")
    path = F.concat(F.lit("80 Daily/"), "event_type", F.when(F.col("user_id") % 2 == 0, "/").otherwise("\\"), F.col("user_id").cast("string"), F.lit(".md"))
    rows = table(spark, d, "events").select(T.log_header(ts, F.col("event_type"), path).alias("header"), reports.commit_message(F.col("event_type"), path).alias("message"))
    return rows.groupBy("header", "message").agg(F.count("*").alias("n"))


HEADERS = "SELECT concat('## [', strftime(ts, '%Y-%m-%d'), '] ', event_type, ' | ', user_id, '.md') AS header, concat(event_type, ': ', user_id, '.md') AS message, count(*) AS n FROM events GROUP BY ALL"


def cleanup_moves(spark, d):
    """Tables of moves in a log that holds other tables and text too."""
    k = F.col("l_linenumber")
    kind = F.when(k % 7 == 1, F.when(F.col("l_returnflag") == "N", "| Old | New |").otherwise("| From | To | Why |")).when(k % 7 == 2, "|---|---|").when(k % 7 == 6, "some text")
    row = F.concat(F.lit("| `"), F.col("l_partkey").cast("string"), F.lit(".md` | "), F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("_archive/"), F.col("l_partkey").cast("string"), F.lit(".md"))), F.lit(" |"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"), F.coalesce(kind, row).alias("text"))
    found = reports.moves(lines, "l_orderkey", "place", "text")
    return found.groupBy("source", "target").agg(F.count("*").alias("n"))


MOVES = """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, coalesce(CASE l_linenumber % 7 WHEN 1 THEN CASE WHEN l_returnflag = 'N' THEN '| Old | New |' ELSE '| From | To | Why |' END WHEN 2 THEN '|---|---|' WHEN 6 THEN 'some text' END, concat('| `', l_partkey, '.md` | ', CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE concat('_archive/', l_partkey, '.md') END, ' |')) AS text FROM lineitem),
s AS (SELECT *, contains(text, 'From') AND contains(text, 'To') AND starts_with(text, '|') AS head, last_value(CASE WHEN contains(text, 'From') AND starts_with(text, '|') THEN 'in' WHEN NOT starts_with(text, '|') THEN 'out' END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM l),
c AS (SELECT list_transform(string_split(text, '|')[2:-2], lambda x: trim(trim(x), '`')) AS c FROM s WHERE state = 'in' AND NOT head AND NOT starts_with(text, '|---')) SELECT c[1] AS source, c[2] AS target, count(*) AS n FROM c WHERE len(c) >= 2 AND c[1] <> '' AND c[2] <> '' GROUP BY ALL"""


def page_articles(spark, d):
    """Articles by class and links to HTML files; each page gets the marks of a plan, whose number its own links give."""
    n = F.regexp_count("html", F.lit("<a "))
    text = F.concat("html", F.when(n % 2 == 0, '<article id="a" class="big session x">').otherwise('<article class="sessions">'), F.lit('<article  CLASS = "item"><article class="item done">'), F.lit("\n[one](plans/_plan_1.html) [two](x.htm) `_plan_2.html`"))
    rows = table(spark, d, "pages").select("page_id", text.alias("t"))
    return rows.select("page_id", T.articles(F.col("t"), "session").alias("n_sessions"), T.articles(F.col("t"), "item").alias("n_items"), F.array_join(T.reference_links(F.col("t")), ",").alias("refs"))


ARTICLES = """WITH t AS (SELECT page_id, concat(html, CASE WHEN len(regexp_extract_all(html, '<a ')) % 2 = 0 THEN '<article id="a" class="big session x">' ELSE '<article class="sessions">' END, '<article  CLASS = "item"><article class="item done">', chr(10), '[one](plans/_plan_1.html) [two](x.htm) `_plan_2.html`') AS t FROM pages)
SELECT page_id, len(regexp_extract_all(t, '(?i)<article[^>]*\\bclass\\s*=\\s*"[^"]*\\bsession\\b[^"]*"'))::INT AS n_sessions, len(regexp_extract_all(t, '(?i)<article[^>]*\\bclass\\s*=\\s*"[^"]*\\bitem\\b[^"]*"'))::INT AS n_items, array_to_string(regexp_extract_all(t, '\\]\\(([^)]+\\.html)\\)', 1), ',') AS refs FROM t"""

SUFFIXES = (".md", ".txt", ".doc", ".html", ".MD", ".zip", ".pdf")


def _dropped(spark, d):
    k = F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("n_chars") % len(SUFFIXES) + 1).cast("int"))
    head = F.when(k % 6 == 0, F.lit("---\nprovenance: ingestion-pipeline\n---\n")).when(k % 6 == 1, F.lit("---\ntitle: Mine\ntags: a,b\nown: kept\n---\n")).when(k % 6 == 2, F.lit("---\ntitle: [open\n---\n")).otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), k.cast("string"), suffix).alias("name"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def extract_notes(spark, d):
    """Documents as dropped files of many types; what each becomes."""
    computed = F.create_map(F.lit("title"), F.lit("Computed"), F.lit("zone"), F.lit("dropped"))
    found = extract.notes(_dropped(spark, d), computed)
    return found.select("name", "handler", "status", "reason", F.col("top")["title"].alias("title"), F.col("top")["type"].alias("type"), F.col("top")["own"].alias("own"), "text_sha256")


EXTRACT = f"""WITH f AS (SELECT concat('d', doc_id, ['.md', '.txt', '.doc', '.html', '.MD', '.zip', '.pdf'][n_chars % 7 + 1]) AS name, coalesce(text, '') AS body, concat(CASE doc_id % 6 WHEN 0 THEN concat('---', chr(10), 'provenance: ingestion-pipeline', chr(10), '---', chr(10)) WHEN 1 THEN concat('---', chr(10), 'title: Mine', chr(10), 'tags: a,b', chr(10), 'own: kept', chr(10), '---', chr(10)) WHEN 2 THEN concat('---', chr(10), 'title: [open', chr(10), '---', chr(10)) ELSE '' END, coalesce(text, '')) AS whole FROM documents),
h AS (SELECT *, CASE lower(regexp_extract(name, '\\.([^.]+)$', 1)) WHEN 'md' THEN 'md' WHEN 'txt' THEN 'txt' WHEN 'html' THEN 'html' WHEN 'pdf' THEN 'pdf' END AS handler FROM f),
r AS (SELECT *, CASE WHEN handler IS NULL THEN 'unsupported_file_type' WHEN handler = 'md' AND starts_with(whole, '---' || chr(10) || 'title: [') THEN 'frontmatter_parse_error' WHEN handler = 'md' AND starts_with(whole, '---' || chr(10) || 'provenance') THEN 'already_ingested' END AS reason FROM h),
s AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'quarantined' WHEN handler IN ('md', 'txt') THEN 'ingested' ELSE 'pending' END AS status, CASE WHEN handler = 'md' THEN CASE WHEN starts_with(whole, '---' || chr(10) || 'title: Mine') THEN regexp_replace(body, '^\\n+', '') ELSE body END ELSE whole END AS text FROM r)
SELECT name, handler, status, reason, CASE WHEN status = 'ingested' THEN CASE WHEN handler = 'md' AND starts_with(whole, '---' || chr(10) || 'title: Mine') THEN 'Mine' ELSE 'Computed' END END AS title, CASE WHEN status = 'ingested' AND handler = 'txt' THEN 'text-note' END AS type,
CASE WHEN status = 'ingested' AND handler = 'md' AND contains(whole, 'own: kept') AND starts_with(whole, '---') THEN 'kept' END AS own, CASE WHEN status = 'ingested' THEN sha256({NORMAL}) END AS text_sha256 FROM s"""


def _staged(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("run"), (F.col("user_id") % 20).cast("string")).alias("run_id"), F.get_json_object("props", "$.k").alias("sha256")).distinct().withColumns({"has_original": F.col("sha256").cast("int") % 3 != 0, "has_note": F.col("sha256").cast("int") % 5 != 0})


def recovery(spark, d):
    """What a recovery appends for each unresolved intent."""
    return ingest.recovered(_manifest(spark, d), _staged(spark, d)).select("run_id", "sha256", "event_id", "status", "reason")


RECOVERY = f"WITH {MANIFEST}, u AS (SELECT run_id, sha256, event_id, sha256::INT AS k FROM m WHERE status = 'intent' AND NOT EXISTS (SELECT 1 FROM m x WHERE x.run_id = m.run_id AND x.sha256 = m.sha256 AND x.status <> 'intent')) SELECT run_id, sha256, event_id, CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN 'skipped' ELSE 'committed' END AS status, CASE WHEN k % 3 = 0 THEN 'staged binary missing' WHEN k % 5 = 0 THEN 'staged note missing' END AS reason FROM u"


def rollback(spark, d):
    return ingest.rolled_back(_manifest(spark, d), "run7", ["ts", "event_id"]).select("run_id", "sha256", "event_id", "status")


ROLLBACK = f"WITH {MANIFEST}, r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY ts DESC, event_id DESC) AS k FROM m WHERE run_id = 'run7') SELECT run_id, sha256, event_id, 'rolled_back' AS status FROM r WHERE k = 1 AND status = 'committed'"


def drift_preview(spark, d):
    """Each document against itself with one word changed throughout: the first twenty lines of the difference."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("old")).withColumn("new", F.replace("old", F.lit("the"), F.lit("THE")))
    return docs.where("old <> new").select("doc_id", reports.drift_preview("old", "new").alias("preview"))


def first_mentions(spark, d):
    """The first mention of each of a text's three longest words as a link."""
    words = F.slice(F.transform(F.array_sort(F.transform(F.array_distinct(T.words(F.col("text"))), lambda w: F.struct((-F.length(w)).alias("low"), w.alias("w")))), lambda x: x["w"]), 1, 3)
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", words.alias("names"))
    return docs.select("doc_id", reports.first_mentions("text", "names").alias("text"))


def rerank_candidates(spark, d):
    """Candidates given as inline JSON, one list for each nation."""
    name = F.col("n_name")
    text = F.concat(F.lit('[{"path": "'), name, F.lit('.md", "score": 0.5, "content": "a \\"quoted\\" text"}, {"path": "b.md", "score": '), F.col("n_regionkey").cast("string"), F.lit("}]"))
    given = F.when(F.col("n_nationkey") % 4 == 0, "no list").otherwise(text)
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(extract.candidates(given)).alias("c"))
    return rows.select("n_nationkey", "c.path", "c.score", "c.content").where("path is not null")


CANDIDATES = "SELECT n_nationkey, concat(n_name, '.md') AS path, 0.5::DOUBLE AS score, 'a \"quoted\" text' AS content FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT n_nationkey, 'b.md', n_regionkey::DOUBLE, NULL FROM nation WHERE n_nationkey % 4 <> 0"

QUERIES = {
    "report_findings": (report_findings, REPORT),
    "json_report": (json_report, FINDINGS + """ SELECT concat('{"action":"', action, '","n":', count(*), ',"rule":"', rule, '"}') AS line FROM r GROUP BY rule, action"""),
    "run_logs": (run_logs, RUN_LOGS),
    "file_table": (file_table, FILE_TABLE),
    "supersession_queue": (supersession_queue, QUEUE),
    "soft_duplicate_queue": (soft_duplicate_queue, SOFT),
    "call_audit": (call_audit, CALLS),
    "registry_upsert": (registry_upsert, UPSERT),
    "log_headers": (log_headers, HEADERS),
    "cleanup_moves": (cleanup_moves, MOVES),
    "page_articles": (page_articles, ARTICLES),
    "extract_notes": (extract_notes, EXTRACT),
    "recovery": (recovery, RECOVERY),
    "rollback": (rollback, ROLLBACK),
    "drift_preview": (drift_preview, None),
    "first_mentions": (first_mentions, None),
    "rerank_candidates": (rerank_candidates, CANDIDATES),
}
