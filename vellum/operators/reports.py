"""What runs leave behind: reports in Markdown and JSON, log lines, queue blocks, registry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import lint


def listed(findings: DataFrame, group: str, line: str, cap: int = 20) -> DataFrame:
    """(group, n, section): a heading with the group's count, its first ``cap`` lines as a list and what remains."""
    rows = lint.signals(findings, group, line, cap)
    items = F.transform("lines", lambda x: F.concat(F.lit("- "), x))
    more = F.when(F.col("n_more") > 0, F.array(F.format_string("- … and %d more", "n_more"))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("## "), F.col(group), F.format_string(" (%d)", "n")), F.lit(""))
    return rows.select(group, "n", F.array_join(F.concat(head, items, more), "\n").alias("section"))


def report(findings: DataFrame, title: str, group: str, line: str, cap: int = 20) -> DataFrame:
    """One row (text): the report of all findings, its sections by group. It is as long as the groups are many, whatever their size."""
    sections = listed(findings, group, line, cap).agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("of"), "n", "section"))).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    body = F.when(F.size("s") > 0, F.array_join(F.transform("s", lambda x: x["section"]), "\n\n")).otherwise(F.lit("No findings."))
    return sections.select(F.concat(F.lit(f"# {title}\n\n"), F.format_string("%d finding(s).\n\n", total), body, F.lit("\n")).alias("text"))


def json_lines(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object with its keys in order; nulls are left out."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Append the only column of ``lines`` as text; a report's rows stay in their order only if there is one."""
    lines.write.mode("append").text(path)


def run_log(results: DataFrame, day: str, run: str = "run_id", status: str = "status") -> DataFrame:
    """(run, daily, auto_write): the daily note's lines and the log's line of each run. ``results`` has a row for each file."""
    n = lambda s: F.count_if(F.col(status) == s)
    rows = results.groupBy(run).agg(F.count("*").alias("n"), *[n(s).alias(s) for s in ("ingested", "quarantined", "skipped", "rejected")])
    daily = F.format_string("### Ingestion `%s`\n%d file(s) scanned: **%d** ingested, **%d** quarantined, **%d** skipped.", run, "n", "ingested", "quarantined", "skipped")
    line = F.format_string(f"{day} | note | ingestion | pipeline run %s: %d ingested, %d quarantined", run, "ingested", "quarantined")
    return rows.select(run, daily.alias("daily"), line.alias("auto_write"))


def file_table(results: DataFrame, run: str, name: str, status: str, reason: str) -> DataFrame:
    """(run, line): a table row for each file of a run."""
    return results.select(run, F.format_string("| `%s` | %s | %s |", name, status, F.coalesce(reason, F.lit(""))).alias("line"))


def supersession_blocks(pairs: DataFrame) -> DataFrame:
    """(new_key, block): what is queued for review when a file supersedes others. ``pairs``: new_key, old_key, sha256 of the older file."""
    old = F.array_sort(F.collect_list(F.struct("old_key", F.substring("sha256", 1, 16).alias("sha"))))
    rows = pairs.groupBy("new_key").agg(old.alias("old"))  # the earlier versions of one file
    lines = F.transform("old", lambda o: F.format_string("- `%s` (SHA: `%s…`)", o["old_key"].cast("string"), o["sha"]))
    return rows.select("new_key", F.array_join(F.concat(F.array(F.concat(F.lit("## Supersession\n\n**New file:** `"), F.col("new_key").cast("string"), F.lit("`\n"))), lines), "\n").alias("block"))


def soft_duplicate_blocks(neighbours: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(key, block): an advisory table of a file's neighbours, best first, where any reaches the threshold. ``neighbours``: key, other, score."""
    near = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), F.col("other").cast("string").alias("other"))))
    rows = neighbours.groupBy("key").agg(F.max("score").alias("top"), near.alias("near")).where(F.col("top") >= threshold)
    # format_number rounds the double itself; %.4f its shortest decimals, so that 0.99385 would be 0.9939
    lines = F.transform("near", lambda x: F.format_string("| %s | `%s` |", F.format_number(-x["low"], 4), x["other"]))
    head = F.format_string("### Soft-duplicate candidate\n\n**New file:** `%s`\n**Top semantic score:** %s\n\n| Score | Nearest neighbour |\n|-------|-------------------|", F.col("key").cast("string"), F.format_number("top", 4))
    return rows.select("key", F.array_join(F.concat(F.array(head), lines), "\n").alias("block"))


def call_audit(calls: DataFrame) -> DataFrame:
    """JSON lines of calls to an outside model: filename, model, sha256, tokens_in, tokens_out, success, error_code; no content."""
    return json_lines(calls.select("filename", "model", "sha256", "tokens_in", "tokens_out", "success", "error_code"))


def upsert(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``held`` with those of ``new`` in place of the ones of their key; repeated, it changes nothing."""
    return held.join(new.select(F.col(key).alias("replaced")).distinct(), F.col(key).eqNullSafe(F.col("replaced")), "left_anti").unionByName(new)


def commit_message(verb: Column, path: Column) -> Column:
    """The message of one write event."""
    return F.concat(verb, F.lit(": "), F.regexp_extract(path, r"([^/\\]+)$", 1))


def moves(lines: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """(key, number, source, target): rows of the tables whose header names From and To; a line that is no row ends a table."""
    row = F.startswith(F.trim(text), F.lit("|"))
    head = row & F.contains(text, F.lit("From")) & F.contains(text, F.lit("To"))
    state = F.when(head, "in").when(~row, "out")
    w = Window.partitionBy(key).orderBy(number)  # the lines of one log
    cells = T.table_cells(F.col(text))
    rows = lines.select(key, number, F.last(state, ignorenulls=True).over(w).alias("state"), head.alias("head"), cells.alias("cells"))
    rows = rows.where((F.col("state") == "in") & ~F.col("head") & (F.size("cells") >= 2))
    return rows.select(key, number, F.col("cells")[0].alias("source"), F.col("cells")[1].alias("target")).where("source <> '' and target <> ''")


def drift_preview(old: str, new: str, most: int = 20):
    """The first ``most`` lines of the unified difference of two text columns; in Arrow batches."""
    import pyarrow as pa

    def preview(left, right):
        from difflib import unified_diff
        from itertools import islice

        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array(["\n".join(islice(unified_diff((a or "").split("\n"), (b or "").split("\n"), "canonical", "project", lineterm=""), most)) for a, b in pairs], pa.string())

    preview.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(preview, "string")(F.col(old), F.col(new))


def first_mentions(text: str, names: str):
    """A text with the first mention of each of an array of names as a wikilink, longer names first, at word boundaries in any case; what is a link already stays; in Arrow batches."""
    import pyarrow as pa

    def enrich(texts, lists):
        import re

        out = []
        for body, wanted in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            body = body or ""
            for name in sorted(set(filter(None, wanted or ())), key=lambda n: (-len(n), n)):
                masked = re.sub(r"\[\[.*?\]\]", lambda m: "\0" * len(m[0]), body, flags=re.DOTALL)
                if re.search(rf"\[\[{re.escape(name)}(?:\||\]\])", body, re.IGNORECASE):
                    continue
                if found := re.search(rf"(?<!\w){re.escape(name)}(?!\w)", masked, re.IGNORECASE):
                    said = body[found.start() : found.end()]
                    body = f"{body[: found.start()]}[[{name}{'' if said == name else '|' + said}]]{body[found.end() :]}"
            out.append(body)
        return pa.array(out, pa.string())

    enrich.__annotations__ = {"texts": pa.Array, "lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(enrich, "string")(F.col(text), F.col(names))
