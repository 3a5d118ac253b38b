"""Hygiene rules: ages, sizes, expiry, backpressure, sections, zones, header and frontmatter rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import dates
from vellum.functions import text as T


def expiry(recommendations: DataFrame, today: str) -> DataFrame:
    """Add expires_at by tier and state: OPEN rows past it are surfaced, tier 3 first, then expired, then the rest."""
    day = F.date_add(F.col("emitted_at").cast("date"), dates.expiry_days(F.col("tier")))
    late = (F.col("status") == "OPEN") & (day < F.lit(today).cast("date"))
    place = F.when(F.col("tier") == 3, 0).when(late, 1).otherwise(2)
    return recommendations.withColumns({"expires_at": day, "expired": late, "place": place})


def backpressure(counts: Column, most: int = 20) -> Column:
    """More than ``most`` open: suppress, with one marker."""
    return F.when(counts > most, "suppress").otherwise("emit")


def cadence_stale(cadence: Column, age: Column) -> Column:
    """Older than the cadence allows; other cadences are never stale."""
    return F.coalesce(age > dates.cadence_limit(cadence), F.lit(False))


def strike(rows: DataFrame, flag: Column, by: list[str], order: list[str], times: int = 3) -> DataFrame:
    """Rows at which the flag has held ``times`` times in a row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - times, 0)
    held = (F.min(flag.cast("int")).over(w) == 1) & (F.count(F.lit(1)).over(w) == times)
    return rows.withColumn("strike", held).where("strike").drop("strike")


def sections(lines: DataFrame, key: str, number: str, text: str, mark: str = "## ") -> DataFrame:
    """(key, header, n_lines): lines attached to the latest header above them; lines before any are left out."""
    header = F.when(F.startswith(text, F.lit(mark)), F.substring(text, len(mark) + 1, 10_000))
    w = Window.partitionBy(key).orderBy(number)  # the lines of one note
    return lines.withColumn("header", F.last(header, ignorenulls=True).over(w)).where(f"header is not null and not startswith({text}, '{mark}')").groupBy(key, "header").agg(F.count("*").alias("n_lines"))


def zone_of(text: Column, zones: dict[str, list[str]], least: int = 2, inbox: str = "00 Inbox") -> Column:
    """The zone whose words a text holds most often; ties and weak scores go to the inbox."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    hits = lambda words: F.size(F.filter(tokens, lambda t: t.isin(words)))
    scores = [hits(words) for words in zones.values()]
    top = F.greatest(*scores)
    ties = reduce(Column.__add__, [(s == top).cast("int") for s in scores])
    named = F.coalesce(*[F.when(s == top, F.lit(zone)) for zone, s in zip(zones, scores, strict=True)])
    return F.when((top < least) | (ties > 1), inbox).otherwise(named)


def downgrade(n_words: Column, kind: Column, unsure: Column, named: Column) -> Column:
    """Why a note is saved to the inbox after all; null if it is not."""
    return F.when(unsure, "uncertain").when((n_words < 200) & (kind != "decision"), "short").when(~named, "no_entity")


def header_row(cells: Column) -> Column:
    """``real`` if the first row's non-empty cells are all strings and no formulas, else ``letters``; an empty row has letters."""
    full = F.filter(cells, lambda c: c["text"].isNotNull() & (c["text"] != ""))
    real = (F.size(full) > 0) & F.forall(full, lambda c: (c["kind"] == "string") & ~F.startswith(c["text"], F.lit("=")))
    return F.when(real, "real").otherwise("letters")


def column_letter(number: Column) -> Column:
    """Spreadsheet letters of a column, counted from 1, up to two letters."""
    one = lambda n: F.char(F.lit(64) + n)
    high = F.floor((number - 1) / 26).cast("int")
    return F.when(high > 0, F.concat(one(high), one((number - 1) % 26 + 1))).otherwise(one(number))


# Keys that ingestion may write at the top of a note's frontmatter.
TOP_LEVEL = "title source_file original_path file_type extracted_at page_count type document_type date slide_count participants meeting_date domain key_data document_date is_latest_version tags".split()


def merge_frontmatter(user: Column, computed: Column, top_level: list[str] = TOP_LEVEL) -> Column:
    """Maps of strings merged, as a struct: ``top`` and ``warnings``.

    At the top stand the computed values of top-level keys; a user's value wins, and
    for a top-level key only where it is not null. So a user's tags stay as they are.
    Other keys of the user pass through; ``pipeline`` is dropped with a warning.
    """
    none = F.array().cast("array<string>")
    held = F.array(*map(F.lit, top_level))
    mine = F.filter(F.coalesce(F.map_keys(user), none), lambda k: (k != "pipeline") & (~F.array_contains(held, k) | F.element_at(user, k).isNotNull()))
    theirs = F.filter(F.coalesce(F.map_keys(computed), none), lambda k: F.array_contains(held, k) & ~F.array_contains(mine, k))
    top = F.map_from_arrays(F.concat(mine, theirs), F.concat(F.transform(mine, lambda k: F.element_at(user, k)), F.transform(theirs, lambda k: F.element_at(computed, k))))
    warned = F.when(F.array_contains(F.coalesce(F.map_keys(user), none), "pipeline"), F.array(F.lit("user_edit_in_pipeline_ns"))).otherwise(none)
    return F.struct(top.alias("top"), warned.alias("warnings"))


def scaffold_path(present: Column, content: Column, user_scope: Column) -> Column:
    """Which of the set-up paths applies."""
    return F.when(~present, "a").when(content & user_scope, "c").otherwise("b")


def rewritten(text: Column, moves: list[tuple[str, str]]) -> Column:
    """For each move the full path first, then the bare name where it changes; both only where they stand on their own."""
    for old, new in moves:
        text = T.rewrite_mentions(text, old, new)
        old_name, new_name = old.rpartition("/")[2], new.rpartition("/")[2]
        if old_name != new_name:
            text = T.rewrite_mentions(text, old_name, new_name)
    return text
