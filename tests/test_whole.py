"""Queries without SQL, and rules that SQL alone would not show, against brute force."""

import difflib
import hashlib
import itertools
import json
import random
import re

import duckdb
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import audit, graph, hygiene, ingest, lint, reports, retrieval
from vellum.plans import catalog
from vellum.sources import extract


def chains(d):
    """Brute force: each user's entries in order, every one with the hash of the one before."""
    out = {}
    for user, event, ts, verb, props in duckdb.execute(f"SELECT user_id, event_id, strftime(ts, '%Y-%m-%dT%H:%MZ'), event_type, props FROM '{d}/events.parquet' ORDER BY event_id").fetchall():
        own = out.setdefault(user, [])
        before = hashlib.sha256(own[-1][1].encode()).hexdigest() if own else audit.GENESIS
        entry = {"format": "v2", "path": f"80 Daily/{event}.md", "prev_hash": before, "reason": props, "ts": ts, "verb": verb}
        own.append((event, json.dumps(entry, separators=(",", ":"), ensure_ascii=False)))
    return out


def test_chains_of_all_events(spark, small):
    want = chains(small)
    got = {r.user_id: (r.n, r.n_errors, r["head"]) for r in catalog.queries()["chain_build_verify"](spark, small).collect()}
    assert got == {u: (len(own), 0, hashlib.sha256(own[-1][1].encode()).hexdigest()) for u, own in want.items()}


def test_chain_escapes_its_values(spark):
    values = ['a "quote"', "back\\slash", "tab\tand\nline", "é   \x1f", None]
    rows = spark.createDataFrame([("c", i, "p", v, "t", "write") for i, v in enumerate(values)], "chain string, seq long, path string, reason string, ts string, verb string")
    lines = audit.build(rows, "chain", "seq")
    assert [json.loads(r.raw)["reason"] for r in lines.orderBy("seq").collect()] == [v or "" for v in values]
    assert audit.verify(lines, "chain", "seq").where("not ok").count() == 0
    assert lines.where(audit.jsonl_error(F.col("raw")).isNotNull()).count() == 0
    by_column = rows.select("seq", audit.line(F.lit(audit.GENESIS), F.col("path"), F.col("reason"), F.col("ts"), F.col("verb")).alias("raw"))
    assert by_column.orderBy("seq").first().raw == lines.orderBy("seq").first().raw


def test_greedy_cap_takes_what_a_whole_pass_takes(spark):
    rng = random.Random(4)
    pairs = [(a, b, round(rng.random(), 2)) for a, b in itertools.combinations(range(40), 2)]
    seen, want = {}, []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if len(want) < 20 and seen.get(a, 0) < 2 and seen.get(b, 0) < 2:
            seen[a], seen[b] = seen.get(a, 0) + 1, seen.get(b, 0) + 1
            want.append((a, b, s))
    frame = spark.createDataFrame(pairs, "a long, b long, score double")
    for top in (20, 1):
        assert sorted(tuple(r) for r in retrieval.greedy_cap(frame, 2, top).collect()) == sorted(want[:top])
    hub = spark.createDataFrame([(0, i, 1 - i / 1000) for i in range(1, 300)] + [(500, 501, 0.1)], "a long, b long, score double")
    assert sorted((r.a, r.b) for r in retrieval.greedy_cap(hub, 1, 2).collect()) == [(0, 1), (500, 501)]


def test_nearest_in_several_blocks(spark, small, monkeypatch):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0")
    want = sorted(tuple(r) for r in retrieval.top_k(e, asked, 5).collect())
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert sorted(tuple(r) for r in retrieval.top_k(e, asked, 5).collect()) == want
    pairs = lambda part: sorted(tuple(r) for r in retrieval.similar_pairs(e, 0.4, part=part).collect())
    assert pairs(37) == pairs(2000)


def test_previews_are_those_of_difflib(spark):
    rows = [("a\nb\nc", "a\nB\nc"), (None, "x"), ("same", "same"), ("\n".join(map(str, range(50))), "\n".join(map(str, range(0, 100, 2))))]
    got = spark.createDataFrame(rows, "old string, new string").select("old", "new", reports.drift_preview("old", "new").alias("p")).collect()
    for r in got:
        assert r.p.split("\n")[:20] == list(difflib.unified_diff((r.old or "").split("\n"), (r.new or "").split("\n"), "canonical", "project", lineterm=""))[:20] or r.p == ""


def test_first_mentions(spark, small):
    text = "Acme met acme ltd and [[Beta|b]], then Acme Ltd. Gammas, gamma and beta."
    row = spark.createDataFrame([(text, ["Acme", "Acme Ltd", "Beta", "gamma", ""]), (None, ["x"]), ("x", None)], "text string, names array<string>")
    got = [r.t for r in row.select(reports.first_mentions("text", "names").alias("t")).collect()]
    assert got == ["[[Acme]] met [[Acme Ltd|acme ltd]] and [[Beta|b]], then Acme Ltd. Gammas, [[gamma]] and beta.", "", "x"]
    for r in catalog.queries()["first_mentions"](spark, small).limit(50).collect():
        assert len(re.findall(r"\[\[", r.text)) >= 1


def test_rewrites_at_boundaries(spark):
    moves = [("10 People/ann.md", "20 Companies/$1/ann_b.md")]
    cases = {
        "see 10 People/ann.md and ann.md, not xann.md or ann.md-old": "see 20 Companies/$1/ann_b.md and ann_b.md, not xann.md or ann.md-old",
        "in x/ann.md": "in x/ann.md",
        "ann.mdx annXmd": "ann.mdx annXmd",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", hygiene.rewritten(F.col("x"), moves).alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases


def test_mentions_of_odd_names(spark):
    notes = spark.createDataFrame([(1, "a b.md, c"), (2, "(x.y.md)"), (3, "xx.y.md"), (4, "a+b(1).md"), (5, None)], "path long, text string")
    names = spark.createDataFrame([("b.md",), ("x.y.md",), ("a+b(1).md",), ("...",)], "name string")
    assert sorted(map(tuple, graph.mentioned(notes, names).collect())) == [("a+b(1).md", 4), ("b.md", 1), ("x.y.md", 2)]


def test_supersession_with_and_without_dates(spark):
    rows = [("s", i, None if i % 5 == 0 else f"2020-{1 + i % 12:02d}-{1 + i % 28:02d}") for i in range(60)]
    files = spark.createDataFrame(rows, "stem string, key long, day string").withColumn("at", F.col("day").cast("date"))
    import datetime

    at = {k: None if d is None else datetime.date.fromisoformat(d) for _, k, d in rows}
    within = {(n, o) for n in at for o in at if n != o and (at[o] is None or (at[n] is not None and at[o] < at[n] and (at[n] - at[o]).days <= 90))}
    beyond = {(n, o) for n in at for o in at if at[n] and at[o] and (at[n] - at[o]).days > 90}
    got = lambda far: {(r.new_key, r.old_key) for r in ingest.supersession(files, "stem", "at", "key", 90, far).collect()}
    assert got(False) == within and got(True) == beyond


def test_reach_by_levels(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(0, 5), (5, 0), (30, 31)], "src long, dst long")
    got = {r.node: r.depth for r in graph.reachable(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: i if i < 5 else i - 4 for i in range(21)}
    assert graph.reachable(edges, spark.createDataFrame([(0,)], "node long"), depth=2).count() == 5


def test_a_type_may_not_be_free_of_its_base(spark):
    import pytest

    with pytest.raises(ValueError):
        lint.without_base(spark.createDataFrame([("a",)], "type string"), ["a"], {"a": "A"}, ["a"])


def test_settings_and_records_from_files(spark, tmp_path):
    import pytest

    (tmp_path / "c.json").write_text('[{"path": "a.md", "score": 0.5, "content": "x"}, {"path": "b.md"}]')
    assert [r.path for r in extract.read_candidates(spark, str(tmp_path / "c.json")).collect()] == ["a.md", "b.md"]
    (tmp_path / "r.json").write_text('[{"q": "x", "s": 1}]')
    assert extract.run_record(spark, str(tmp_path / "r.json"), "q string, s int").first().s == 1
    (tmp_path / "bad.json").write_text('{"q": "x"}')
    with pytest.raises(ValueError):
        extract.run_record(spark, str(tmp_path / "bad.json"), "q string")
    reports.write_lines(spark.createDataFrame([("one",)], "line string"), str(tmp_path / "out"))
    reports.write_lines(spark.createDataFrame([("two",)], "line string"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["one", "two"]


def test_stripping_of_chain_keys(spark):
    names = {"Plan_v3_full": "plan", "6_pager": "6pager", "6pager_v2.1": "6pager", "deck_v2_client_x": "deck", "a_readonly_clean": "areadonly", "note": "note"}
    got = {r.n: r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", T.chain_key(F.col("n")).alias("k")).collect()}
    assert got == names
