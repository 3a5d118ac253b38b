"""Golden cases worked out by hand, and properties."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import dates
from vellum.functions import text as T
from vellum.operators import audit, graph, hygiene, ingest, retrieval, views
from vellum.operators.html import to_markdown_text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return row.select(column.alias("out")).first().out


@pytest.mark.parametrize(
    ("name", "stem"),
    [
        ("Q1_report_v2.pdf", "q1_report"), ("Q1_report_v3.pdf", "q1_report"), ("RACI_v1.2.xlsx", "raci"), ("meeting_notes_2026-05-13.docx", "meeting_notes"),
        ("2026-05-13_notes.md", "2026-05-13_notes"), ("plan_draft2 (2).md", "plan"), ("deck final_v3 copy.pptx", "deck"), ("plain.md", "plain"), ("a_-_v2_-.md", "a"),
    ],
)
def test_stem(spark, name, stem):
    assert one(spark, T.stem(F.col("x")), x=name) == stem


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["_v2", "-final", " copy", "_draft3", "(2)", "_2024-01-02", "x", "_", " "]), max_size=6))
def test_stem_is_stable(spark, parts):
    name = "base" + "".join(parts) + ".md"
    first = one(spark, T.stem(F.col("x"), 4), x=name)
    assert one(spark, T.stem(F.col("x"), 4), x=first + ".md") == first


@pytest.mark.parametrize(("text", "plain"), [("A\r\nB  \t C \rD", "a\nb c\nd"), ("  x \n\n y  ", "x\n\n y"), ("", ""), ("\t\n", ""), ("É  \n", "é")])
def test_normalize(spark, text, plain):
    assert one(spark, T.normalize(F.col("x")), x=text) == plain


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="aB \t\n\r.é", max_size=30))
def test_normalize_twice(spark, text):
    first = one(spark, T.normalize(F.col("x")), x=text)
    assert one(spark, T.normalize(F.col("x")), x=first) == first


@pytest.mark.parametrize(("reply", "verdict"), [("YES", "YES"), ("yes", "YES"), ("NO. text", "NO"), ("PARTIAL - text", "PARTIAL"), ("other text", None), ("", None), (None, None), ("Nothing", None)])
def test_verdict(spark, reply, verdict):
    assert one(spark, T.verdict(F.col("x"))[0], x=reply) == verdict


@pytest.mark.parametrize(("text", "lang"), [("de a", "unknown"), (" ".join(["do"] * 13 + ["the"] * 10), "unknown"), (" ".join(["do"] * 14 + ["the"] * 10), "pt"), ("the of and to", "en"), ("", "unknown")])
def test_language(spark, text, lang):
    assert one(spark, T.language(F.col("x"))[2], x=text) == lang


@pytest.mark.parametrize(("text", "day"), [("2024-02-29", datetime.date(2024, 2, 29)), ('"2024-01-05"', datetime.date(2024, 1, 5)), ("2024-01-05T10:00:00Z", datetime.date(2024, 1, 5)), ("2024-02-30", None), ("soon", None), (None, None)])
def test_dates(spark, text, day):
    assert one(spark, dates.parse(F.col("x")), x=text) == day


def test_links(spark):
    rows = spark.createDataFrame([("n", "[[A]] ![[b/C.md#s|alias]] [[D|x]] [[]] [E]")], "path string, text string")
    assert [r.target for r in graph.links(rows).orderBy("position").collect()] == ["A", "C", "D"]


@pytest.mark.parametrize(
    ("query", "route"),
    [("what is current", "A"), ("current price as of 2024-01-01", "B"), ("current history", "C"), ("plain question", "D"), ("history as of then", "AMBIGUOUS"), ("in 2025 we grew", "B"), ("knowledge", "D")],
)
def test_route(spark, query, route):
    assert one(spark, retrieval.route(F.col("x")), x=query) == route


def test_view_nulls(spark):
    rows = spark.createDataFrame([(1, True, "v1", None), (2, None, "", "2024-05-01"), (3, False, None, "2024-06-01")], "id int, is_latest_version boolean, document_version string, superseded_date string")
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert ids(rows.where(views.compile_filter("is_latest_version != false"))) == [1, 2]
    assert ids(rows.where(views.compile_filter('superseded_date == ""'))) == [1]
    assert ids(rows.where(views.compile_filter('document_version != ""'))) == [1]
    assert ids(rows.where(views.compile_filter({"not": ["is_latest_version == true"]}))) == [2, 3]
    assert ids(rows.where(views.compile_filter({"or": ["id < 2", {"and": ["id >= 3", 'document_version == ""']}]}))) == [1, 3]
    with pytest.raises(ValueError):
        views.compile_filter("id ~ 3")


def test_as_of(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", None), (2, "2024-01-01", "2024-03-01"), (3, "2024-01-01", "2024-03-02"), (4, "2024-03-02", None)], "id int, document_date string, superseded_date string")
    rows = rows.selectExpr("id", "cast(document_date as date) document_date", "cast(superseded_date as date) superseded_date")
    assert sorted(r.id for r in views.as_of(rows, "2024-03-01").collect()) == [1, 3]


def test_required_keys(spark):
    rows = spark.createDataFrame([("a", "t", None, []), ("b", "t", "  ", ["x"]), ("c", "t", "0", ["x"]), ("d", "u", None, None)], "path string, type string, k string, l array<string>")
    assert sorted((r.path, r.missing_key) for r in views.missing_keys(rows, {"t": ["k", "l"]}).collect()) == [("a", "k"), ("a", "l"), ("b", "k")]


def test_greedy_cap(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7)], "a long, b long, score double")
    assert sorted((r.a, r.b) for r in retrieval.greedy_cap(pairs, 1).collect()) == [(1, 2), (3, 4)]


def test_faithfulness(spark):
    rows = [(1, "YES"), (1, "YES"), (2, "YES"), (2, "NO"), (3, "YES"), (3, "PARTIAL"), (4, None), (5, "PARTIAL"), (5, None)]
    got = {r.q_id: (r.score, r.verdict) for r in retrieval.faithfulness(spark.createDataFrame(rows, "q_id int, verdict string")).collect()}
    assert got == {1: (1.0, "YES"), 2: (0.5, "MIXED"), 3: (0.75, "MIXED"), 4: (None, "deferred"), 5: (0.5, "PARTIAL")}


def test_run_cut(spark):
    files = spark.createDataFrame([("r", i, 40) for i in range(5)], "run string, n int, size int")
    assert [r.state for r in ingest.run_cut(files, "run", ["n"], "size", 100).orderBy("n").collect()] == ["processed"] * 3 + ["skipped"] * 2


def test_tiers(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "A b"), (3, "a  B "), (4, ""), (5, " "), (6, None)], "doc_id int, text string")
    got = {r.doc_id: r.status for r in ingest.tiered_dedup(docs).collect()}
    assert got == {1: "ingested", 2: "exact_duplicate", 3: "content_duplicate", 4: "ingested", 5: "ingested", 6: "exact_duplicate"}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sampled_from(["flip", "drop", "swap"]), st.integers(0, 8))
def test_chain_tamper(spark, how, at):
    entries = spark.createDataFrame([(1, i, f"p{i}", "r", "t", "v") for i in range(10)], "c int, seq long, path string, reason string, ts string, verb string")
    raw = [r.raw for r in audit.build(entries, "c", "seq").orderBy("seq").collect()]
    if how == "flip":
        raw[at] = raw[at].replace(f'"p{at}"', '"other"')
    elif how == "drop":
        del raw[at]
    else:
        raw[at], raw[at + 1] = raw[at + 1], raw[at]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(raw)], "c int, seq long, raw string")
    assert audit.verify(lines, "c", "seq").where("not ok").count() > 0


def test_reachability_grows(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (3, 6)], "src int, dst int")
    near = lambda seeds: {r.node: r.depth for r in graph.reachable(edges, spark.createDataFrame([(s,) for s in seeds], "node int")).collect()}
    assert near([1]) == {1: 0, 2: 1, 3: 2, 6: 3}
    assert set(near([1])) <= set(near([1, 4]))
    assert near([9]) == {9: 0}


def test_backpressure_and_expiry(spark):
    assert one(spark, hygiene.backpressure(F.col("n")), n=20) == "emit"
    assert one(spark, hygiene.backpressure(F.col("n")), n=21) == "suppress"


def test_markdown():
    html = "<html><head><title>no</title></head><h1>T</h1><p>a <b>b</b> <a href='u'>c</a></p><ul><li>x</li><li>y<ol><li>z</li></ol></li></ul><table><tr><th>h</th></tr><tr><td>d|e</td></tr></table><script>s</script>"
    assert to_markdown_text(html) == "# T\n\na **b** [c](u)\n\n- x\n\n- y\n\n  1. z\n\n| h |\n| --- |\n| d\\|e |"
    assert to_markdown_text(None) is None
    assert to_markdown_text("") == ""


def test_only_small_text_tables_are_dealt_out(spark, small, monkeypatch):
    from vellum import session

    assert session.size_of(spark.read.parquet(f"{small}/documents.parquet")) == 1428373
    cores = spark.sparkContext.defaultParallelism
    assert session.table(spark, small, "documents").rdd.getNumPartitions() == cores
    monkeypatch.setattr(session, "SMALL", 1000)
    assert session.table(spark, small, "documents").rdd.getNumPartitions() == 1
