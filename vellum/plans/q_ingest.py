"""Queries on ingestion: hashes, tiers, stems, supersession, the manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import ingest
from vellum.scratch import scratch_path
from vellum.session import table
from vellum.sources import ledger

NORMAL = r"""regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '[ \t\f\v]+(\n|$)', '\1', 'g')), '^\s+|\s+$', '', 'g')"""


def ingest_tiered_dedup(spark, d):
    docs = table(spark, d, "documents")
    found = ingest.tiered_dedup(docs)
    rows = found.join(docs.select("doc_id", "source", "n_chars"), "doc_id")
    return rows.groupBy("source", "status").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


TIERED = f"""
WITH h AS (SELECT doc_id, source, n_chars, sha256(coalesce(text, '')) AS s, {NORMAL} AS p FROM documents),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY s) AS fs, CASE WHEN p <> '' THEN min(doc_id) OVER (PARTITION BY p) END AS fp FROM h)
SELECT source, CASE WHEN doc_id > fs THEN 'exact_duplicate' WHEN doc_id > fp THEN 'content_duplicate' ELSE 'ingested' END AS status,
       count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM f GROUP BY ALL"""


def text_normalize_hash(spark, d):
    text = T.normalize(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", text.alias("p")).select("doc_id", T.sha256(F.col("p")).alias("text_sha256"), F.length("p").alias("n_plain"))


def _names(spark, d):
    k = F.col("o_orderkey")
    tail = F.when(k % 7 == 0, F.concat(F.lit("_v"), (k % 5).cast("string"))).when(k % 7 == 1, F.lit("-final")).when(k % 7 == 2, F.concat(F.lit("_draft"), (k % 3).cast("string"), F.lit(" (2)")))
    tail = tail.when(k % 7 == 3, F.concat(F.lit("_"), F.date_format("o_orderdate", "yyyy-MM-dd"))).when(k % 7 == 4, F.lit("_rev3_clean")).when(k % 7 == 5, F.lit("_v1.2 copy")).otherwise("")
    name = F.concat(F.lit("Order_"), F.col("o_custkey").cast("string"), F.lit("_"), F.col("o_orderstatus"), tail, F.lit(".pdf"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", name.alias("name"))


NAMES = """SELECT o_orderkey, o_orderdate, concat('Order_', o_custkey, '_', o_orderstatus, CASE o_orderkey % 7 WHEN 0 THEN concat('_v', o_orderkey % 5) WHEN 1 THEN '-final'
  WHEN 2 THEN concat('_draft', o_orderkey % 3, ' (2)') WHEN 3 THEN concat('_', strftime(o_orderdate, '%Y-%m-%d')) WHEN 4 THEN '_rev3_clean' WHEN 5 THEN '_v1.2 copy' ELSE '' END, '.pdf') AS name FROM orders"""


def supersession_stem(spark, d):
    return _names(spark, d).select(T.stem(F.col("name")).alias("stem"), "name").groupBy("stem").agg(F.count("*").alias("n_files"), F.countDistinct("name").alias("n_names"))


def _versions(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_v"), (F.col("p_partkey") % 12).cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".1").otherwise(""), F.lit(".md")).alias("name")).select("name").distinct()


def superseded_versions(spark, d):
    return ingest.superseded_versions(_versions(spark, d))


VERSIONS = r"""
WITH n AS (SELECT DISTINCT concat(replace(p_name, ' ', '_'), '_v', p_partkey % 12, CASE WHEN p_partkey % 3 = 0 THEN '.1' ELSE '' END, '.md') AS name FROM part),
v AS (SELECT name, regexp_extract(name, '^(.+)_v(\d+)(?:\.\d+)?\.md$', 1) AS stem, regexp_extract(name, '^(.+)_v(\d+)(?:\.\d+)?\.md$', 2)::INT AS version FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY version DESC, name DESC) AS k, max(version) OVER (PARTITION BY stem) AS latest_version FROM v)
SELECT name, stem, version, latest_version FROM r WHERE k > 1"""


def _supersession(beyond):
    def query(spark, d):
        files = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("stem"), F.col("o_orderdate").cast("date").alias("at"))
        return ingest.supersession(files, "stem", "at", "o_orderkey", 90, beyond).select("stem", "new_key", "old_key", "gap_days")

    return query


def _supersession_sql(op):
    return f"""SELECT concat('cust', a.o_custkey) AS stem, a.o_orderkey AS new_key, b.o_orderkey AS old_key, date_diff('day', b.o_orderdate::DATE, a.o_orderdate::DATE)::INT AS gap_days
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate::DATE < a.o_orderdate::DATE AND a.o_orderkey <> b.o_orderkey
WHERE date_diff('day', b.o_orderdate::DATE, a.o_orderdate::DATE) {op} 90"""


def _manifest(spark, d):
    kind = F.col("event_type")
    status = F.when(kind.isin("click", "view"), "intent").when(kind == "purchase", "committed").when(kind == "error", "quarantined").otherwise("rolled_back")
    return table(spark, d, "events").select(
        F.concat(F.lit("run"), (F.col("user_id") % 20).cast("string")).alias("run_id"), F.get_json_object("props", "$.k").alias("sha256"), "event_id", "ts", status.alias("status"), "value"
    )


MANIFEST = """m AS (SELECT concat('run', user_id % 20) AS run_id, (props::JSON ->> 'k') AS sha256, event_id, ts, value,
  CASE WHEN event_type IN ('click', 'view') THEN 'intent' WHEN event_type = 'purchase' THEN 'committed' WHEN event_type = 'error' THEN 'quarantined' ELSE 'rolled_back' END AS status FROM events)"""


def manifest_current_state(spark, d):
    return ingest.current_state(_manifest(spark, d), ["run_id", "sha256"], ["ts", "event_id"]).select("run_id", "sha256", "event_id", "status")


def intent_unresolved(spark, d):
    return ingest.unresolved(_manifest(spark, d)).select("run_id", "sha256", "event_id")


def run_summary(spark, d):
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("intent", "committed", "quarantined", "rolled_back")]
    return _manifest(spark, d).groupBy("run_id").agg(*counts, F.countDistinct("sha256").alias("n_files"), F.round(F.sum("value"), 2).alias("size"))


def run_size_cut(spark, d):
    files = _manifest(spark, d).withColumn("bytes", F.round(F.col("value") * 100).cast("long"))
    return ingest.run_cut(files, "run_id", ["ts", "event_id"], "bytes", 500_000).groupBy("run_id", "state").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def commit_protocol(spark, d):
    """Events as files, committed to a ledger in two batches of which the second comes twice; by batch and run what is read back."""
    path = scratch_path(spark, "ledger")
    files = _manifest(spark, d).select("run_id", "sha256", F.col("event_id").alias("file_no"))
    for batch, rest in (("a", 0), ("b", 1), ("b", 1)):
        ledger.append(files.where(F.col("file_no") % 2 == rest), path, batch)
    rows = ledger.read(spark, path, "run_id string, sha256 string, file_no long, status string")
    whole = rows.groupBy("batch").agg(F.min("manifest_offset").alias("offset"), F.max(F.col("manifest_offset") + F.col("n_bytes")).alias("end"), F.countDistinct("manifest_offset").alias("n_lines"))
    runs = rows.groupBy("batch", "run_id").agg(F.count_if(F.col("status") == "intent").alias("n_intent"), F.count_if(F.col("status") == "committed").alias("n_committed"), F.countDistinct("file_no").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))
    return runs.join(F.broadcast(whole), "batch")  # a row for each batch


COMMITS = """l AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS batch, run_id, event_id, status, length(concat('{"run_id":"', run_id, '","sha256":"', sha256, '","file_no":', event_id, ',"status":"', s.status, '"}')) + 1 AS n FROM (SELECT run_id, sha256, event_id FROM m), (SELECT unnest(['intent', 'committed']) AS status) s),
w AS (SELECT batch, count(*) AS n_lines, sum(n)::BIGINT AS size FROM l GROUP BY batch), o AS (SELECT batch, n_lines, (sum(size) OVER (ORDER BY batch))::BIGINT AS "end", size FROM w)
SELECT l.batch, run_id, count(*) FILTER (status = 'intent') AS n_intent, count(*) FILTER (status = 'committed') AS n_committed, count(DISTINCT event_id) AS n_files, sum(n)::BIGINT AS n_bytes, "end" - size AS "offset", "end", n_lines FROM l JOIN o ON o.batch = l.batch GROUP BY ALL"""


def exact_dup_semi(spark, d):
    """Events whose file was committed in another run."""
    m = _manifest(spark, d)
    done = m.where("status = 'committed'").groupBy("sha256").agg(F.min("run_id").alias("low"), F.max("run_id").alias("high"))
    return m.where("status = 'intent'").join(done, "sha256").where("low <> run_id or high <> run_id").groupBy("run_id").agg(F.count("*").alias("n"))


def backfill_classes(spark, d):
    """Documents against the manifest by hash of their id: known, recomputed or orphaned."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 120).cast("string").alias("k"), "n_chars")
    known = _manifest(spark, d).where("status = 'committed'").select(F.col("sha256").alias("k")).distinct().withColumn("known", F.lit(True))
    kind = F.when(F.col("known"), "known").when(F.col("n_chars") >= 1000, "recomputed").otherwise("orphaned")
    return docs.join(known, "k", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def dir_hash(spark, d):
    """One hash for each source over the sorted hashes of its texts."""
    docs = table(spark, d, "part").select("p_brand", T.sha256(F.concat_ws("|", "p_partkey", "p_name")).alias("h"))
    return docs.groupBy("p_brand").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("h"))).cast("binary"), 256).alias("dir_sha256"), F.count("*").alias("n_files"))


def file_names(spark, d):
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit("_Plan.md"))
    files = table(spark, d, "part").select("p_partkey", name.alias("name"))
    taken = files.groupBy("name").agg(F.min("p_partkey").alias("first"))
    rows = files.join(taken, "name")
    sha = T.sha256(F.col("p_partkey").cast("string"))
    return rows.select("p_partkey", T.slug(F.col("name")).alias("slug"), T.title(F.col("name")).alias("title"), T.safe_file_name(F.col("name"), sha, F.col("p_partkey") > F.col("first")).alias("file_name"))


FILE_NAMES = r"""WITH n AS (SELECT p_partkey, concat(p_name, ' ', p_brand, '_Plan.md') AS name FROM part),
t AS (SELECT *, p_partkey > min(p_partkey) OVER (PARTITION BY name) AS taken, regexp_replace(name, '[^A-Za-z0-9._-]+', '_', 'g') AS clean, regexp_replace(name, '\.[^./]*$', '') AS base FROM n)
SELECT p_partkey, left(trim(regexp_replace(lower(base), '[^a-z0-9]+', '-', 'g'), '-'), 80) AS slug, left(trim(regexp_replace(base, '[_-]+', ' ', 'g')), 120) AS title,
  CASE WHEN taken THEN concat(regexp_replace(clean, '\.[^.]*$', ''), '-', left(sha256(p_partkey::VARCHAR), 8), regexp_extract(clean, '\.[^.]*$')) ELSE clean END AS file_name FROM t"""

QUERIES = {
    "ingest_tiered_dedup": (ingest_tiered_dedup, TIERED),
    "text_normalize_hash": (text_normalize_hash, f"SELECT doc_id, sha256(p) AS text_sha256, length(p)::INT AS n_plain FROM (SELECT doc_id, {NORMAL} AS p FROM documents)"),
    "supersession_stem": (
        supersession_stem,
        f"""SELECT lower(trim(regexp_replace(regexp_replace(name, '\\.[^./]*$', ''),
  '(?i)(?:[_\\-\\s]+(?:v\\d+(?:\\.\\d+)*|ver\\d+(?:\\.\\d+)*|rev\\d+|draft\\d*|final|clean|\\d{{4}}[_\\-]?\\d{{2}}[_\\-]?\\d{{2}}|\\d{{6,8}}|\\(\\d+\\)|copy\\d*))+\\s*$', ''), ' _-')) AS stem,
  count(*) AS n_files, count(DISTINCT name) AS n_names FROM ({NAMES}) GROUP BY 1""",
    ),
    "superseded_versions": (superseded_versions, VERSIONS),
    "supersession_window": (_supersession(False), _supersession_sql("<=")),
    "long_window_matches": (_supersession(True), _supersession_sql(">")),
    "manifest_current_state": (manifest_current_state, f"WITH {MANIFEST}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, sha256 ORDER BY ts DESC, event_id DESC) AS k FROM m) SELECT run_id, sha256, event_id, status FROM r WHERE k = 1"),
    "intent_unresolved": (intent_unresolved, f"WITH {MANIFEST} SELECT run_id, sha256, event_id FROM m WHERE status = 'intent' AND NOT EXISTS (SELECT 1 FROM m x WHERE x.run_id = m.run_id AND x.sha256 = m.sha256 AND x.status <> 'intent')"),
    "run_summary": (run_summary, f"WITH {MANIFEST} SELECT run_id, count(*) FILTER (status = 'intent') AS n_intent, count(*) FILTER (status = 'committed') AS n_committed, count(*) FILTER (status = 'quarantined') AS n_quarantined, count(*) FILTER (status = 'rolled_back') AS n_rolled_back, count(DISTINCT sha256) AS n_files, round(sum(value), 2) AS size FROM m GROUP BY run_id"),
    "run_size_cut": (run_size_cut, f"WITH {MANIFEST}, b AS (SELECT run_id, round(value * 100)::BIGINT AS bytes, ts, event_id FROM m), c AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT run_id, CASE WHEN before >= 500000 THEN 'skipped' ELSE 'processed' END AS state, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM c GROUP BY ALL"),
    "commit_protocol": (commit_protocol, f"WITH {MANIFEST}, {COMMITS}"),
    "exact_dup_semi": (exact_dup_semi, f"WITH {MANIFEST} SELECT run_id, count(*) AS n FROM m WHERE status = 'intent' AND EXISTS (SELECT 1 FROM m x WHERE x.sha256 = m.sha256 AND x.status = 'committed' AND x.run_id <> m.run_id) GROUP BY run_id"),
    "backfill_classes": (backfill_classes, f"WITH {MANIFEST}, k AS (SELECT DISTINCT sha256 FROM m WHERE status = 'committed') SELECT CASE WHEN k.sha256 IS NOT NULL THEN 'known' WHEN n_chars >= 1000 THEN 'recomputed' ELSE 'orphaned' END AS kind, count(*) AS n FROM documents LEFT JOIN k ON (doc_id % 120)::VARCHAR = k.sha256 GROUP BY 1"),
    "dir_hash": (dir_hash, "SELECT p_brand, sha256(string_agg(h, chr(10) ORDER BY h)) AS dir_sha256, count(*) AS n_files FROM (SELECT p_brand, sha256(concat(p_partkey, '|', p_name)) AS h FROM part) GROUP BY p_brand"),
    "file_names": (file_names, FILE_NAMES),
}
