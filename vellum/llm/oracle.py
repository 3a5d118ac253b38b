"""SQL for DuckDB that gives the results of the operators that SQL can express."""

from __future__ import annotations

from vellum.llm import secrets, sharding

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def secret_scan() -> str:
    """Places follow from the lengths of the matches and of what lies between them."""
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT id, '{rule.kind}' AS kind, {rank} AS rank, {str(rule.base).lower()} AS base, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(a := list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), n := length(m[i]), c := length(c[i])))) AS s "
            f"FROM (SELECT id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS c, string_split_regex(text, '{pattern}') AS gaps FROM t WHERE regexp_matches(text, '{pattern}'))"
        )
    least = "CASE kind " + " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in secrets.RULES) + " END"
    said = "concat(kind, ':', s.a::BIGINT, ':', (s.a + s.n)::BIGINT)"
    return f"""WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents), f AS ({' UNION ALL '.join(parts)}), k AS (SELECT *, {said} AS said FROM f WHERE s.c >= {least}),
g AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(said, ',' ORDER BY s.a, rank) FILTER (base) AS b, string_agg(said, ',' ORDER BY s.a, rank) AS spans FROM k GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g ON g.id = t.id"""


def decontamination(window: int = 10) -> str:
    words = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, {words} AS w FROM documents), b AS (SELECT row_number() OVER () AS no, coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
win AS (SELECT no, item, j, least(len(w), {window}) AS n, array_to_string(w[j:j + {window - 1}], ' ') AS g FROM (SELECT no, item, w, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS j FROM b WHERE len(w) > 0)),
pos AS (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
m AS (SELECT p.id, p.i, p.n, win.no, win.item, win.j FROM pos p JOIN win ON win.n = p.n AND win.g = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
h AS (SELECT id, count(DISTINCT i + k) AS n_hit FROM m, range({window}) t(k) WHERE k < n GROUP BY id),
j AS (SELECT id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT id, item FROM m) GROUP BY id),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY id, no, i - j ORDER BY i) AS run FROM m),
long AS (SELECT DISTINCT id, concat_ws(':', item, min(j) - 1, min(i) - 1, max(i) - min(i) + any_value(n)) AS said, max(i) - min(i) + any_value(n) AS size FROM runs GROUP BY id, no, item, i - j, run),
l AS (SELECT id, count(*) AS n_matches, max(size)::BIGINT AS longest, sha256(string_agg(said, ',' ORDER BY said)) AS said FROM long GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
coalesce(n_matches, 0) AS n_matches, coalesce(longest, 0) AS longest_match, coalesce(said, sha256('')) AS matches_sha256 FROM d LEFT JOIN h ON h.id = d.id LEFT JOIN j ON j.id = d.id LEFT JOIN l ON l.id = d.id"""


def shards() -> str:
    """The claiming in turn is not SQL; the filled table goes in as a literal, and its fill is tested apart."""
    table = ",".join(map(str, sharding.fill_table(sharding.shard_names())))
    return f"""WITH s AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {sharding.SLOTS})::INT AS slot FROM documents), p AS (SELECT doc_id, slot, string_split('{table}', ',')[slot + 1]::INT AS shard_no FROM s)
SELECT doc_id, slot, shard_no, concat('shard-', lpad(shard_no::VARCHAR, 4, '0')) AS shard FROM p"""


def jaccard_join(k: int = 4, percent: int = 85) -> str:
    words = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, reach) AS (SELECT DISTINCT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach), c AS (SELECT node, min(reach) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(k.n_links, 0) AS n_links FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM u GROUP BY a) k ON k.a = d.doc_id"""
