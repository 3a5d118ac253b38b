"""Date functions; the day that counts as today is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """A date from ``YYYY-MM-DD``, quoted or not, or from the start of an ISO timestamp; null if it is none."""
    day = F.regexp_extract(F.trim(F.regexp_replace(text, "[\"']", "")), r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])", 1)
    return F.try_to_timestamp(F.when(day != "", day), F.lit("yyyy-MM-dd")).cast("date")


def age_days(day: Column, today: str) -> Column:
    return F.datediff(F.lit(today).cast("date"), day)


def expiry_days(tier: Column) -> Column:
    """Days that a recommendation stays open, by tier."""
    return F.when(tier == 1, 7).when(tier == 2, 14).when(tier == 3, 30)


def cadence_limit(cadence: Column) -> Column:
    """Days after which a note of this cadence is stale; null: never."""
    return F.when(cadence == "weekly", 7).when(cadence == "monthly", 30)


def stated_day(text: Column) -> Column:
    """The day that a note gives: ``last_updated`` of its frontmatter, or the first date in its first 500 characters."""
    head = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)
    named = F.regexp_extract(head, r"(?m)^last_updated\s*:\s*[\"']?([^\s\"']+)", 1)
    bare = F.regexp_extract(F.substring(text, 1, 500), r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    return parse(F.coalesce(F.nullif(named, F.lit("")), F.nullif(bare, F.lit(""))))


def last_touched(updated: Column, document: Column, modified: Column) -> Column:
    """The day of a note: last_updated, else document_date, else the file's own."""
    return F.coalesce(updated.cast("date"), document.cast("date"), modified.cast("date"))


def quarter_suffix(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string"))
