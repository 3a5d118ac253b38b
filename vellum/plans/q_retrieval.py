"""Queries on vectors, the retrieval cascade and its evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import climb, entities, rank, retrieval, views
from vellum.scratch import materialize, scratch_path
from vellum.session import table

COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


def cosine_topk(spark, d):
    """Nearest five of every vector whose id is divisible by fifty."""
    e = table(spark, d, "embeddings")
    return retrieval.top_k(e, e.where("vec_id % 50 = 0"), 5, dim=64)


TOPK = f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5"""


def _pairs(spark, d, threshold=0.35):
    return retrieval.similar_pairs(table(spark, d, "embeddings"), threshold)


PAIRS = f"p AS (SELECT a.vec_id AS a, b.vec_id AS b, {COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} >= %s)"


def cosine_pairs(spark, d):
    return _pairs(spark, d)


def soft_duplicates(spark, d):
    """Vectors with a neighbour at or above the threshold: how many, and the best score."""
    p = _pairs(spark, d, 0.4)
    both = p.select(F.col("a").alias("vec_id"), "score").union(p.select("b", "score"))
    return both.groupBy("vec_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def pairs_greedy_cap(spark, d):
    return retrieval.greedy_cap(_pairs(spark, d, 0.3), cap=5, top=200)


def see_also(spark, d):
    return retrieval.see_also(_pairs(spark, d, 0.4), 0.4)


SEE_ALSO = "WITH " + PAIRS % 0.4 + """, x AS (SELECT a AS key, b AS other, score FROM p UNION ALL SELECT b, a, score FROM p)
SELECT key, concat('<!-- pipeline:see-also -->', chr(10), '## See also', chr(10), chr(10), string_agg(format('- [[{}]] (score {:.2f})', other, score), chr(10) ORDER BY score DESC, other), chr(10), '<!-- /pipeline:see-also -->') AS block FROM x GROUP BY key"""


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def rerank_lexical(spark, d):
    """The best three of all documents by shared words for every question."""
    return retrieval.best_lexical(_questions(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text"), 3)


RERANK = r"""WITH q AS (SELECT item_id AS query_id, list_distinct(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x))) AS w FROM benchmark),
c AS (SELECT doc_id AS path, list_transform(regexp_extract_all(left(text, 4096), '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS t FROM documents),
s AS (SELECT query_id, path, round(len(list_intersect(w, t)) / greatest(len(w), 1)::DOUBLE, 6) AS rerank_score FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, path)::INT AS rerank_rank FROM s) SELECT * FROM r WHERE rerank_rank <= 3"""

PHRASES = ("what is the latest plan", "as of 2024-03-01 who led it", "how did the plan change: its history", "who owns the plan", "the current history of it", "prices in 2023 and their evolution", "what was agreed prior to the merger", "is the site live today")


def _asked(spark, d):
    words = F.array(*map(F.lit, PHRASES))
    return table(spark, d, "customer").select("c_custkey", F.element_at(words, (F.col("c_custkey") % len(PHRASES) + 1).cast("int")).alias("query"))


def temporal_route(spark, d):
    return _asked(spark, d).select("query", retrieval.route(F.col("query")).alias("route")).groupBy("query", "route").agg(F.count("*").alias("n"))


ROUTES = "SELECT q[c_custkey % 8 + 1] AS query, ['A', 'B', 'C', 'D', 'C', 'AMBIGUOUS', 'B', 'A'][c_custkey % 8 + 1] AS route, count(*) AS n FROM customer, (SELECT [" + ", ".join(f"'{p}'" for p in PHRASES) + "] AS q) GROUP BY ALL"


def _steps(spark, d):
    """Catalogue, lexical, semantic and structured hits of each benchmark item among documents.

    The catalogue matches titles, which are a text's first three words; a view of long
    English notes answers where the first word is that of a note's title; a vector
    stands for the item or document of its number.
    """
    q = _questions(spark, d)
    docs = table(spark, d, "documents")
    asked = q.where(F.size(T.words("query")) > 0).select(F.col("query_id").alias("entity_id"), F.lower("query").alias("surface"))
    lexical = entities.exact_matches(docs.select("doc_id", F.lower("text").alias("text")), asked, whole=False).select(F.col("entity_id").alias("query_id"), F.col("key").alias("hit"))
    opening = lambda text, n: F.array_join(F.slice(T.words(F.lower(text)), 1, n), " ")
    titles = docs.select(F.col("doc_id").alias("hit"), opening("text", 3).alias("title")).where("title <> ''")
    catalog = q.select("query_id", opening("query", 3).alias("title")).join(titles, "title").select("query_id", "hit")
    view = docs.where(views.compile_filter({"and": ['lang == "en"', "n_chars >= 3000"]})).select(F.col("doc_id").alias("hit"), opening("text", 1).alias("first"))
    structured = q.select("query_id", opening("query", 1).alias("first")).where("first <> ''").join(view, "first").select("query_id", "hit")
    e = table(spark, d, "embeddings")
    asked = e.join(q.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    semantic = retrieval.top_k(e, asked, 1).where("score >= 0.3").select("query_id", F.col("vec_id").alias("hit"))
    return [("0.0 catalog", catalog), ("0.1 lexical", lexical), ("1 semantic", semantic), ("2 structured", structured)]


STEPS = f"""q AS (SELECT item_id AS query_id, lower(text) AS s, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark), t AS (SELECT doc_id, lang, n_chars, lower(text) AS t, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS v FROM documents),
near AS (SELECT a.vec_id AS query_id, b.vec_id AS hit, {COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit) AS k FROM near),
h AS (SELECT query_id, doc_id AS hit, 0 AS place, '0.0 catalog' AS step FROM q JOIN t ON array_to_string(w[1:3], ' ') = array_to_string(v[1:3], ' ') AND len(v) > 0
UNION ALL SELECT query_id, doc_id, 1, '0.1 lexical' FROM q JOIN t ON contains(t, s) AND len(w) > 0 UNION ALL SELECT query_id, hit, 2, '1 semantic' FROM best WHERE k = 1 AND score >= 0.3
UNION ALL SELECT query_id, doc_id, 3, '2 structured' FROM q JOIN t ON w[1] = v[1] WHERE lang = 'en' AND n_chars >= 3000)"""


def ppr_queries(spark, d):
    """For each benchmark item the note that connects those it names, or why there is no rank: documents' first words as notes, linked to the words that follow."""
    q = _questions(spark, d)
    opening = materialize(table(spark, d, "documents").select(T.first_words(F.lower("text"), 4).alias("w")).where(F.size("w") >= 1).distinct(), "openings")
    stems = opening.select(F.col("w")[0].alias("node")).where(F.length("node") >= 3).distinct()
    edges = opening.select(F.col("w")[0].alias("src"), F.explode(F.slice("w", 2, 3)).alias("dst")).where("src <> dst")
    seeds = materialize(rank.seeds_of(q, stems), "ppr-seeds")
    why = rank.skip_reasons(q, seeds)
    asked = seeds.join(why.where("reason is null").select("query_id"), "query_id", "left_semi")
    # what is not a seed connects them
    found = rank.push_rank(edges, asked, least=1e-6, within=5e-4).join(seeds, ["query_id", "node"], "left_anti")
    top = rank.best(found, 1).select("query_id", F.col("node").alias("connector"), F.round("score", 3).alias("score"), (F.col("bound") < 0.001).alias("near"))
    return why.join(top, "query_id", "left").select("query_id", "n_seeds", "reason", "connector", "score", "near")


def _ppr_queries_sql(levels=40):
    return f"""WITH RECURSIVE q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM benchmark), o AS (SELECT DISTINCT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')[1:4] AS w FROM documents),
e AS (SELECT DISTINCT src, dst FROM (SELECT w[1] AS src, unnest(w[2:4]) AS dst FROM o WHERE len(w) > 0) WHERE src <> dst), g AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM e),
s AS MATERIALIZED (SELECT DISTINCT query_id, node FROM (SELECT query_id, unnest(w) AS node FROM q) JOIN (SELECT DISTINCT w[1] AS stem FROM o WHERE length(w[1]) >= 3) ON stem = node),
y AS (SELECT q.query_id, count(node) AS n_seeds FROM q LEFT JOIN s ON s.query_id = q.query_id GROUP BY 1),
m(level, query_id, node, x) AS (SELECT 0, s.query_id, s.node, 1.0::DOUBLE / n_seeds FROM s JOIN y ON y.query_id = s.query_id WHERE n_seeds >= 2
UNION ALL SELECT level + 1, query_id, dst, sum({rank.DAMPING}::DOUBLE * x / degree) FROM m JOIN g ON src = node WHERE level < {levels} GROUP BY level, query_id, dst),
p AS (SELECT query_id, node, sum({1 - rank.DAMPING:.2f}::DOUBLE * x) AS score FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, node) AS k FROM p ANTI JOIN s ON s.query_id = p.query_id AND s.node = p.node)
SELECT y.query_id, n_seeds, CASE n_seeds WHEN 0 THEN '{rank.NO_SEED}' WHEN 1 THEN '{rank.ONE_SEED}' END AS reason, r.node AS connector, round(score, 3) AS score, CASE WHEN r.node IS NOT NULL THEN true END AS near FROM y LEFT JOIN r ON r.query_id = y.query_id AND k = 1"""


def retrieval_cascade(spark, d):
    return retrieval.first_hits(_steps(spark, d))


def confidence_tier(spark, d):
    """How many steps answer each query, and so how far it is to be trusted."""
    hits = None
    for name, step in _steps(spark, d):
        more = step.select("query_id", F.lit(name).alias("step")).distinct()
        hits = more if hits is None else hits.union(more)
    n = hits.groupBy("query_id").agg(F.countDistinct("step").alias("n_steps"))
    return _questions(spark, d).join(n, "query_id", "left").select("query_id", F.coalesce("n_steps", F.lit(0)).alias("n_steps")).withColumn("tier", retrieval.tier(F.col("n_steps")))


def _scored(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", *[F.when(k % m == 0, None).when(k % b == 0, 0).otherwise(1).alias(n) for n, m, b in (("s", 7, 4), ("x", 11, 9), ("t", 5, 3))])


SCORED = "o AS (SELECT o_orderpriority, " + ", ".join(f"CASE WHEN o_orderkey % {m} = 0 THEN NULL WHEN o_orderkey % {b} = 0 THEN 0 ELSE 1 END AS {n}" for n, m, b in (("s", 7, 4), ("x", 11, 9), ("t", 5, 3))) + " FROM orders)"


def eval_dimensions(spark, d):
    pct = lambda c: F.round(100 * F.avg(c), 4)
    rows = _scored(spark, d).groupBy("o_orderpriority").agg(*[pct(c).alias(f"{c}_pct") for c in "sxt"])
    return rows.withColumn("mean_pct", F.round((F.col("s_pct") + F.col("x_pct") + F.col("t_pct")) / 3, 4)).withColumn("gate", (F.col("s_pct") >= 80) & (F.col("x_pct") >= 80) & (F.col("t_pct") >= 80))


DIMENSIONS = f"WITH {SCORED}, a AS (SELECT o_orderpriority, round(100 * avg(s), 4) AS s_pct, round(100 * avg(x), 4) AS x_pct, round(100 * avg(t), 4) AS t_pct FROM o GROUP BY 1) SELECT *, round((s_pct + x_pct + t_pct) / 3, 4) AS mean_pct, s_pct >= 80 AND x_pct >= 80 AND t_pct >= 80 AS gate FROM a"


def ir_metrics(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")).alias("rank"), (F.col("l_partkey") % 3 == 0).cast("int").alias("relevant"))
    return retrieval.ir_metrics(rows)


IR = """WITH r AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber) AS rank, (l_partkey % 3 = 0)::INT AS relevant FROM lineitem),
q AS (SELECT query_id, coalesce(sum(relevant) FILTER (rank = 1), 0) AS p1, coalesce(sum(relevant) FILTER (rank <= 5), 0) / 5.0::DOUBLE AS p5, coalesce(1.0::DOUBLE / min(rank) FILTER (relevant = 1), 0) AS rr, coalesce(sum(relevant) FILTER (rank <= 10), 0) AS found, sum(relevant) AS n, coalesce(sum(relevant / log2(rank + 1)) FILTER (rank <= 5), 0) AS dcg FROM r GROUP BY 1),
i AS (SELECT *, (SELECT sum(1 / log2(k + 1)) FROM range(1, 6) t(k) WHERE k <= n) AS ideal FROM q)
SELECT round(avg(p1), 6) AS p_at_1, round(avg(p5), 6) AS p_at_5, round(avg(rr), 6) AS mrr, round(avg(CASE WHEN n > 0 THEN found::DOUBLE / n END), 6) AS recall_at_10, round(avg(CASE WHEN n > 0 THEN dcg / ideal END), 6) AS ndcg_at_5, count(*) AS n_queries FROM i"""

REPLIES = ("YES - supported", "no. it is not", "PARTIAL: half of it", "maybe so", "Yes\nall of it", "")


def faithfulness_rollup(spark, d):
    """Two judges' replies for each part, parsed and averaged."""
    reply = lambda c: F.element_at(F.array(*map(F.lit, REPLIES)), (c % len(REPLIES) + 1).cast("int"))
    p = table(spark, d, "part")
    judged = p.select(F.col("p_partkey").alias("q_id"), reply(F.col("p_partkey")).alias("reply")).union(p.select("p_partkey", reply(F.col("p_partkey") * 7 + F.col("p_size"))))
    return retrieval.faithfulness(judged.withColumn("verdict", T.verdict(F.col("reply"))[0])).groupBy("verdict", "score", "single_judge").agg(F.count("*").alias("n"))


FAITH = """WITH v AS (SELECT ['YES', 'NO', 'PARTIAL', NULL, 'YES', NULL] AS v), j AS (SELECT p_partkey, v[p_partkey % 6 + 1] AS a, v[(p_partkey * 7 + p_size) % 6 + 1] AS b FROM part, v),
m AS (SELECT p_partkey, unnest([a, b]) AS verdict FROM j), s AS (SELECT p_partkey, round(avg(CASE verdict WHEN 'YES' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 WHEN 'NO' THEN 0.0 END), 6) AS score, CASE WHEN count(verdict) = 0 THEN 'deferred' WHEN count(DISTINCT verdict) = 1 THEN min(verdict) ELSE 'MIXED' END AS verdict, count(verdict) = 1 AS single_judge FROM m GROUP BY 1)
SELECT verdict, score, single_judge, count(*) AS n FROM s GROUP BY ALL"""


def spot_check(spark, d):
    """One document a source, by a hash that the month seeds."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.sha2(F.concat(F.lit("2024-05:"), F.col("doc_id").cast("string")), 256).alias("h"))
    return docs.groupBy("source").agg(F.min_by("doc_id", "h").alias("doc_id"))


def eval_balance(spark, d):
    """Whether each kind of question has its floor, and the share of the first kind."""
    kind = F.element_at(F.array(*map(F.lit, "LSBWDSS")), (F.col("c_custkey") % 7 + 1).cast("int"))
    rows = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("suite")).agg(*[F.count_if(kind == k).alias(f"n_{k.lower()}") for k in "LSBWD"], F.count("*").alias("n"))
    return rows.withColumn("ok", (F.least("n_l", "n_s", "n_b", "n_w", "n_d") >= 2) & (F.col("n_s") / F.col("n") >= 0.4))


BALANCE = "WITH c AS (SELECT c_mktsegment AS suite, 'LSBWDSS'[c_custkey % 7 + 1] AS k FROM customer) SELECT suite, " + ", ".join(f"count(*) FILTER (k = '{k}') AS n_{k.lower()}" for k in "LSBWD") + ", count(*) AS n, least(n_l, n_s, n_b, n_w, n_d) >= 2 AND n_s::DOUBLE / n >= 0.4 AS ok FROM c GROUP BY suite"


def smoke_checks(spark, d):
    """Whether any expected document is among the first five of each query: doc ids by length."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return docs.where("rank <= 5").groupBy("source").agg(F.max((F.col("doc_id") % 7 == 0).cast("int")).alias("passed"))


def hill_climb(spark, d):
    """Keep or revert by round: the median score of a day's runs against the best so far."""
    runs = table(spark, d, "events").where("event_type = 'view'").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"))
    best = F.max("median").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))  # a row a day
    return runs.select("day", "median", F.when(best.isNull() | (F.col("median") > best), "keep").otherwise("revert").alias("decision"))


HILL = "WITH r AS (SELECT ts::DATE AS day, round(quantile_cont(value, 0.5), 6) AS median FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT *, max(median) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r) SELECT day, median, CASE WHEN best IS NULL OR median > best THEN 'keep' ELSE 'revert' END AS decision FROM b"

def climb_rounds(spark, d):
    """Days of events as changes tried one after the other, kinds of event as evaluations, their values as runs, until a rule stops; interrupted once on the way."""
    events = materialize(table(spark, d, "events").select(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("eval"), (F.col("value") / 1000).alias("score")), "climb-runs")
    days = [r.day for r in events.select("day").distinct().orderBy("day").collect()]  # the changes to try
    path = scratch_path(spark, "climb")

    def go(budget):
        return climb.climb(spark, path, lambda log: climb.Change(days[len(log)]) if len(log) < len(days) else None, lambda change: events.where(F.col("day") == change.name), budget=budget)

    go(7)
    why = go(None)
    return climb.history(spark, path).select("round", "change", "score", "decision", F.lit(why).alias("ended"))


CLIMB = """WITH m AS (SELECT ts::DATE::VARCHAR AS day, event_type, median(value / 1000) AS m FROM events GROUP BY ALL), s AS (SELECT day, round(avg(m), 6) AS score, row_number() OVER (ORDER BY day) AS round FROM m GROUP BY day),
b AS (SELECT *, score > coalesce(max(score) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS keep, min(score) OVER (ORDER BY round ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS low FROM s),
i AS (SELECT *, round - max(CASE WHEN keep THEN round END) OVER (ORDER BY round) AS idle FROM b), e AS (SELECT min(round) AS last FROM i WHERE (round >= 20 AND idle >= 5) OR (round >= 3 AND low >= 1)),
w AS (SELECT CASE WHEN last IS NULL THEN 'done' WHEN (SELECT low FROM i WHERE round = last) >= 1 THEN 'perfect' ELSE 'plateau' END AS ended, coalesce(last, 1000000) AS last FROM e)
SELECT round::INT AS round, day AS change, score, CASE WHEN keep THEN 'keep' ELSE 'revert' END AS decision, ended FROM i, w WHERE round <= last"""


QUERIES = {
    "climb_rounds": (climb_rounds, CLIMB),
    "cosine_topk": (cosine_topk, TOPK),
    "cosine_pairs": (cosine_pairs, "WITH " + PAIRS % 0.35 + " SELECT * FROM p"),
    "soft_duplicates": (soft_duplicates, "WITH " + PAIRS % 0.4 + ", x AS (SELECT a AS vec_id, score FROM p UNION ALL SELECT b, score FROM p) SELECT vec_id, count(*) AS n, max(score) AS best FROM x GROUP BY vec_id"),
    "pairs_greedy_cap": (pairs_greedy_cap, None),
    "see_also": (see_also, SEE_ALSO),
    "rerank_lexical": (rerank_lexical, RERANK),
    "ppr_queries": (ppr_queries, _ppr_queries_sql()),
    "temporal_route": (temporal_route, ROUTES),
    "retrieval_cascade": (retrieval_cascade, f"WITH {STEPS}, l AS (SELECT query_id, min(place) AS place FROM h GROUP BY 1) SELECT DISTINCT h.query_id, h.step, h.hit FROM h JOIN l ON l.query_id = h.query_id AND l.place = h.place"),
    "confidence_tier": (confidence_tier, f"WITH {STEPS}, n AS (SELECT q.query_id, count(DISTINCT step) AS n_steps FROM q LEFT JOIN h ON h.query_id = q.query_id GROUP BY 1) SELECT *, CASE WHEN n_steps >= 2 THEN 'normal' WHEN n_steps = 1 THEN 'low' ELSE 'refuse' END AS tier FROM n"),
    "eval_dimensions": (eval_dimensions, DIMENSIONS),
    "ir_metrics": (ir_metrics, IR),
    "faithfulness_rollup": (faithfulness_rollup, FAITH),
    "spot_check": (spot_check, "SELECT source, arg_min(doc_id, sha256(concat('2024-05:', doc_id))) AS doc_id FROM documents GROUP BY source"),
    "eval_balance": (eval_balance, BALANCE),
    "smoke_checks": (smoke_checks, "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT source, max((doc_id % 7 = 0)::INT) AS passed FROM r WHERE k <= 5 GROUP BY source"),
    "hill_climb": (hill_climb, HILL),
}
