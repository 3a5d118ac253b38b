"""Queries on text: language, statistics, entities, HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import entities, html, textstats
from vellum.session import table

QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)
TOKENS = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: lower(x))"


def _lang(spark, d):
    pt, en, lang = T.language(F.col("text"))
    return table(spark, d, "documents").select("doc_id", "lang", pt.alias("pt_hits"), en.alias("en_hits"), lang.alias("detected"))


HITS = f"h AS (SELECT doc_id, lang, len(list_filter({TOKENS}, lambda x: x IN ({QUOTED(T.PT_STOPWORDS)})))::INT AS pt_hits, len(list_filter({TOKENS}, lambda x: x IN ({QUOTED(T.EN_STOPWORDS)})))::INT AS en_hits FROM documents)"


def stopword_hits(spark, d):
    return _lang(spark, d).select("doc_id", "pt_hits", "en_hits")


def lang_detect(spark, d):
    return _lang(spark, d).groupBy("lang", "detected").agg(F.count("*").alias("n"))


def corpus_stats(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lengths = textstats.sentence_lengths(docs)
    whole = docs.agg(F.count("*").alias("n_docs"), F.sum(F.size(T.words(F.col("text")))).alias("n_words"), F.sum(F.regexp_count("text", F.lit("[—–]"))).alias("n_dashes"), F.sum(F.regexp_count("text", F.lit(r"(?m)^\s*[-*•]\s+"))).alias("n_bullets"))
    return whole.crossJoin(lengths.agg(F.count("*").alias("n_sentences"), F.round(F.avg("n_words"), 6).alias("avg_words"))).crossJoin(textstats.order_statistics(lengths, "n_words", {"median_words": 0.5, "p90_words": 0.9}))


# Sentence ends are marked with a character that no text has, since RE2 cannot look around.
STATS = """WITH s AS (SELECT unnest(string_split(regexp_replace(text, '([.!?])\\s+([A-ZÀ-Þ])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS x FROM documents),
l AS (SELECT len(regexp_extract_all(x, '[\\p{L}\\p{N}_]+'))::INT AS n FROM s WHERE trim(x) <> ''), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM l)
SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')))::BIGINT FROM documents) AS n_words, (SELECT sum(len(regexp_extract_all(text, '[—–]')))::BIGINT FROM documents) AS n_dashes,
(SELECT sum(len(regexp_extract_all(text, '(?m)^\\s*[-*•]\\s+')))::BIGINT FROM documents) AS n_bullets, (SELECT count(*) FROM l) AS n_sentences, (SELECT round(avg(n), 6) FROM l) AS avg_words,
(SELECT n FROM o WHERE k = floor(c * 0.5)) AS median_words, (SELECT n FROM o WHERE k = floor(c * 0.9)) AS p90_words"""


def ngram_top20(spark, d):
    return textstats.ngrams(table(spark, d, "documents"))


NGRAMS = f"""WITH t AS (SELECT list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS t FROM documents),
g AS (SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: t[i:i + 2])) AS g FROM t WHERE len(t) >= 3)
SELECT array_to_string(g, ' ') AS ngram, count(*) AS n FROM g WHERE len(list_filter(g, lambda x: x NOT IN ({QUOTED(T.NGRAM_STOPWORDS)}))) > 0 GROUP BY 1 ORDER BY n DESC, ngram LIMIT 20"""


def ngrams_across(spark, d):
    """All documents as one text in the order of their id, as the reference reads a corpus."""
    return textstats.ngrams(table(spark, d, "documents"), 3, 20, across="doc_id")


NGRAMS_ACROSS = f"""WITH w AS (SELECT doc_id, unnest(t) AS a, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS t FROM documents)),
g AS (SELECT a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (ORDER BY doc_id, i))
SELECT concat(a, ' ', b, ' ', c) AS ngram, count(*) AS n FROM g WHERE c IS NOT NULL AND NOT (a IN ({QUOTED(T.NGRAM_STOPWORDS)}) AND b IN ({QUOTED(T.NGRAM_STOPWORDS)}) AND c IN ({QUOTED(T.NGRAM_STOPWORDS)})) GROUP BY 1 ORDER BY n DESC, ngram LIMIT 20"""


def openers(spark, d):
    return textstats.openers(table(spark, d, "conversations"))


OPENERS = """WITH f AS (SELECT list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(x, '#'))[1] AS x FROM conversations),
s AS (SELECT string_split(regexp_replace(trim(x), '([.!?])\\s+([A-ZÀ-Þ])', '\\1' || chr(1) || '\\2', 'g'), chr(1))[1] AS s FROM f WHERE x IS NOT NULL), w AS (SELECT regexp_extract_all(s, '[\\p{L}\\p{N}_]+')[1:5] AS w FROM s)
SELECT array_to_string(w, ' ') AS opener, count(*) AS n FROM w WHERE len(w) >= 2 GROUP BY 1 ORDER BY n DESC, opener LIMIT 10"""


def closers(spark, d):
    """Letters: each text with a closing line in its language, and a name under it."""
    line = F.when(F.col("lang") == "en", "Best regards,").when(F.col("lang") == "es", "Saludos cordiales").when(F.col("lang") == "fr", "Obg a todos").otherwise("Sincerely")
    letters = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), line, F.lit("\nA Name")).alias("text"))
    return textstats.closers(letters)


CLOSERS = """WITH l AS (SELECT list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM (SELECT concat(coalesce(text, ''), chr(10), chr(10), CASE lang WHEN 'en' THEN 'Best regards,' WHEN 'es' THEN 'Saludos cordiales' WHEN 'fr' THEN 'Obg a todos' ELSE 'Sincerely' END, chr(10), 'A Name') AS text FROM documents)), t AS (SELECT list_reverse(l[greatest(len(l) - 4, 1):]) AS t FROM l),
h AS (SELECT list_filter(t, lambda x: regexp_matches(x, '(?i)^(SIGNS)') AND len(regexp_extract_all(x, '[\\p{L}\\p{N}_]+')) <= 6)[1] AS closer FROM t)
SELECT closer, count(*) AS n FROM h WHERE closer IS NOT NULL GROUP BY 1 ORDER BY n DESC, closer LIMIT 10""".replace("SIGNS", "|".join(T.SIGN_OFFS))

PHRASES = ("The And", "of the", "all rights reserved", "licensed under", "not there at all")


def phrase_counts(spark, d):
    return textstats.phrase_counts(table(spark, d, "documents"), PHRASES)


PHRASE_SQL = " UNION ALL ".join(f"SELECT '{p}' AS phrase, sum((length(text) - length(replace(lower(text), '{p.lower()}', ''))) // {len(p)})::BIGINT AS n FROM documents HAVING n > 0" for p in PHRASES)


def entity_link_candidates(spark, d):
    """Benchmark passages as entities, under the passage itself and its first and last word; at most fifty of a document."""
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("entity_id"), F.lower("text").alias("whole")).withColumn("w", T.words(F.col("whole")))
    catalogue = items.select("entity_id", F.explode(F.array("whole", F.get("w", F.lit(0)), F.get("w", F.size("w") - 1))).alias("surface"))
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return entities.link_candidates(docs, catalogue).select("doc_id", "entity_id", F.md5("matched").alias("matched"), "start", "end", "wikilink", "truncated")


ENTITIES = """WITH i AS (SELECT item_id::VARCHAR AS id, lower(text) AS s, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark), e AS (SELECT DISTINCT id, s FROM (SELECT id, unnest([s, w[1], w[-1]]) AS s FROM i) WHERE s <> ''),
m AS (SELECT doc_id, t, s, string_split(t, s) AS p FROM (SELECT doc_id, lower(text) AS t FROM documents), (SELECT DISTINCT s FROM e) WHERE contains(t, s)),
o AS (SELECT doc_id, t, s, unnest(list_transform(range(1, len(p)), lambda k: list_sum(list_transform(p[1:k], lambda x: length(x)))::BIGINT + (k - 1) * length(s))) AS a FROM m),
f AS (SELECT doc_id, s, min(a) AS a FROM o WHERE NOT regexp_matches(t[a:a], '[\\p{L}\\p{N}_]') AND NOT regexp_matches(t[a + length(s) + 1:a + length(s) + 1], '[\\p{L}\\p{N}_]') GROUP BY doc_id, s),
r AS (SELECT doc_id, id, s, a, row_number() OVER (PARTITION BY doc_id ORDER BY a, a + length(s), id, s) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM f JOIN e USING (s))
SELECT doc_id, id AS entity_id, md5(s) AS matched, a AS start, a + length(s) AS "end", concat('[[', id, ']]') AS wikilink, greatest(n - 50, 0) AS truncated FROM r WHERE k <= 50"""


def html_links(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(html.hrefs(F.col("html"))).alias("href"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_targets"), F.min("href").alias("first_href"))


HTML_LINKS = """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets, min(href) AS first_href FROM h GROUP BY page_id"""


def html_features(spark, d):
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in html.features(F.col("html")).items()])


HTML_FEATURES = "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '{p}'))::INT AS {n}" for n, p in (("n_tables", "<table\\b"), ("n_links", "<a\\s"), ("n_headings", "<h[1-6]\\b"), ("n_items", "<li\\b"), ("n_images", "<img\\b"))) + " FROM pages"


def html_to_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", html.to_markdown("html").alias("markdown"))


def html_escape(spark, d):
    text = F.concat(F.lit("<"), F.col("p_type"), F.lit(' & "'), F.col("p_name"), F.lit('">')).alias("x")
    filled = T.fill(F.lit("{{NAME}} of {{NAME_LONG}} {{UNKNOWN}}"), {"NAME": F.col("p_brand"), "NAME_LONG": F.col("p_name")})
    return table(spark, d, "part").select("p_partkey", text, filled.alias("filled")).select("p_partkey", T.escape(F.col("x"), True).alias("escaped"), "filled", F.size(F.regexp_extract_all("filled", F.lit(r"\{\{([A-Z_]+)\}\}"), F.lit(1))).alias("n_unresolved"))


HTML_ESCAPE = "SELECT p_partkey, concat('&lt;', p_type, ' &amp; &quot;', p_name, '&quot;&gt;') AS escaped, concat(p_brand, ' of ', p_name, ' {{UNKNOWN}}') AS filled, 1 AS n_unresolved FROM part"

QUERIES = {
    "stopword_hits": (stopword_hits, f"WITH {HITS} SELECT doc_id, pt_hits, en_hits FROM h"),
    "lang_detect": (lang_detect, f"WITH {HITS} SELECT lang, CASE WHEN greatest(pt_hits, en_hits) < 3 THEN 'unknown' WHEN pt_hits > en_hits * 1.3 THEN 'pt' WHEN en_hits > pt_hits * 1.3 THEN 'en' ELSE 'unknown' END AS detected, count(*) AS n FROM h GROUP BY ALL"),
    "corpus_stats": (corpus_stats, STATS),
    "ngram_top20": (ngram_top20, NGRAMS),
    "ngrams_across": (ngrams_across, NGRAMS_ACROSS),
    "openers": (openers, OPENERS),
    "closers": (closers, CLOSERS),
    "phrase_counts": (phrase_counts, PHRASE_SQL),
    "entity_link_candidates": (entity_link_candidates, ENTITIES),
    "html_links": (html_links, HTML_LINKS),
    "html_features": (html_features, HTML_FEATURES),
    "html_to_markdown": (html_to_markdown, None),
    "html_escape": (html_escape, HTML_ESCAPE),
}
