"""Secret scan over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression yields a Boolean trigram query: an AND over the
stretches of the pattern that every match must contain, each an OR over the
literal strings that it may be, each of those an AND of trigrams. The index holds
postings (trigram, doc_id) for the trigrams of the rules; intersecting them gives
the candidates of each rule, and only these are verified with the expression. A
rule without a mandatory trigram (a bare run of hex digits) scans every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.scratch import documents, materialize, sized


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 0  # shorter matches are dropped after matching
    base: bool = False


# The base rules, in the order in which spans of equal start are listed, then the added ones.
RULES = (
    Rule("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("code_host", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

#: A stretch of a pattern may stand for so many strings; beyond, it is split there.
STRINGS = 64


def _strings(items) -> tuple[list[set[str]], bool]:
    """Stretches of a parsed pattern, each as the lower-case strings one of which every match contains there; whether they are one that stands for the whole pattern."""
    done: list[set[str]] = []
    now, whole = {""}, True

    def close() -> None:
        nonlocal now, whole
        whole = False  # also where nothing was open, as before a leading class
        if now != {""}:
            done.append(now)
        now = {""}

    def extend(options: set[str]) -> None:
        nonlocal now
        if len(now) * len(options) > STRINGS:
            close()
        now = {a + b for a, b in product(now, options)}

    for op, arg in items:
        if op is sre.LITERAL:
            extend({chr(arg).lower()})
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            extend({chr(a).lower() for _, a in arg})
        elif op is sre.SUBPATTERN:
            inner, alone = _strings(arg[3])
            if alone and len(inner) == 1:
                extend(inner[0])
            else:
                close()
                done += inner
        elif op is sre.BRANCH:
            each = [_strings(x) for x in arg[1]]
            if all(alone and len(inner) == 1 for inner, alone in each):
                extend(set().union(*(inner[0] for inner, _ in each)))
            else:
                close()
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            inner, alone = _strings(sub)
            if alone and len(inner) == 1 and (low, high) == (0, 1):
                extend({""} | inner[0])
            elif alone and len(inner) == 1 and low == high and low <= 8:
                for _ in range(low):
                    extend(inner[0])
            else:
                close()
        elif op is not sre.AT:
            close()
    one = whole
    close()
    return done, one


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND of ORs of ANDs of trigrams; empty if no trigram is mandatory."""
    found = []
    for options in _strings(parser.parse(pattern))[0]:
        if all(len(s) >= 3 for s in options):
            clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in options}
            found.append(sorted(tuple(sorted(c)) for c in clauses if not any(other < c for other in clauses)))
    return [[list(clause) for clause in clauses] for clauses in found]


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, doc_id), one for each document that has the trigram in either case.

    ``grams`` come from the rules, so a document has a bounded number of postings.
    """
    text = docs.select("doc_id", F.lower("text").alias("folded")).where(F.col("folded") != "")
    held = F.filter(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    return text.select("doc_id", F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules) -> DataFrame:
    """Intersect postings: (doc_id, kinds) for documents that satisfy some rule's trigram query."""
    held = index.groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))  # at most the rules' trigrams

    def satisfied(query) -> Column:
        has_all = lambda clause: F.size(F.array_except(F.array(*map(F.lit, clause)), "grams")) == 0
        return reduce(Column.__and__, (reduce(Column.__or__, map(has_all, clauses)) for clauses in query))

    kinds = F.filter(F.array(*[F.when(satisfied(trigram_query(r.pattern)), F.lit(r.kind)) for r in rules]), lambda k: k.isNotNull())
    return held.select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, rank, end, kind), in code points; short ones dropped afterwards."""
    pattern = F.lit(rule.pattern)
    gaps = F.split("text", rule.pattern, -1)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    counted = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else whole
    steps = F.zip_with(F.slice(gaps, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), counted.alias("c")), lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m["w"]).alias("size"), F.length(m["c"]).alias("counted")))
    one = lambda start, end: F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["size"]).alias("at"),
            F.when(s["counted"] >= rule.least, F.concat(acc["out"], F.array(one(acc["at"] + s["gap"], acc["at"] + s["gap"] + s["size"])))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.col("text").rlike(rule.pattern), walked).otherwise(none)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """Spans of every rule in every text: doc_id, and an array ``<kind>_spans`` for each rule.

    A null text counts as empty and has none. A null doc_id keeps its row. Repeated
    rows each get their spans. Spans of one rule do not overlap, those of several may;
    of equal starts the rule listed first comes first. Columns besides doc_id and text
    are ignored. A text of any length is matched whole. An empty table gives an empty
    result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    indexed = [r for r in rules if trigram_query(r.pattern)]
    grams = sorted({g for r in indexed for clauses in trigram_query(r.pattern) for clause in clauses for g in clause})
    found = sized(materialize(candidates(build_index(docs, grams), indexed), "secret-candidates"))
    found = found.select(F.col("doc_id").alias("candidate_id"), "kinds")
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col("candidate_id")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    columns = []
    for rank, rule in enumerate(rules):
        spans = _spans(rule, rank)
        if rule in indexed:
            spans = F.when(F.array_contains("kinds", rule.kind), spans).otherwise(none)
        columns.append(spans.alias(f"{rule.kind}_spans"))
    return both.select("doc_id", *columns)


def _joined(spans: Column) -> Column:
    said = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(said, ",")


def digest(scanned: DataFrame, rules=RULES) -> DataFrame:
    base = [f"{r.kind}_spans" for r in rules if r.base]
    every = [f"{r.kind}_spans" for r in rules]
    return scanned.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{c.removesuffix('_spans')}") for c in base],
        F.sha2(_joined(F.concat(*base)), 256).alias("base_sha256"),
        _joined(F.concat(*every)).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(documents(spark, sf_dir)))
