"""HTML to Markdown, and what a page links to."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from vellum.scratch import small_batches

# Tags without an end tag, tags whose text is left out, block tags.
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
SKIPPED = {"script", "style", "head", "noscript", "template"}
BLOCKS = {"p", "div", "article", "section", "header", "footer", "main", "nav", "aside", "ul", "ol", "table", "tr", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre"}


class _Markdown(HTMLParser):
    """Collects blocks of Markdown; inline marks go around their text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.lists: list[list] = []
        self.prefix, self.skip, self.href = "", 0, None
        self.row: list[str] | None = None
        self.rows: list[list[str]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.line).split())
        if text:
            self.blocks.append(self.prefix + text)
        self.line, self.prefix = [], ""

    def handle_starttag(self, tag, attrs) -> None:
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        values = dict(attrs)
        if tag in BLOCKS:
            self.flush()
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.prefix = "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- ")
        elif tag[0] == "h" and tag[1:].isdigit():
            self.prefix = "#" * int(tag[1:]) + " "
        elif tag == "blockquote":
            self.prefix = "> "
        elif tag in ("strong", "b"):
            self.line.append("**")
        elif tag in ("em", "i"):
            self.line.append("*")
        elif tag == "a":
            self.href = values.get("href") or ""
            self.line.append("[")
        elif tag == "img":
            self.line.append(f"![{values.get('alt') or ''}]({values.get('src') or ''})")
        elif tag == "br":
            self.flush()
        elif tag == "table":
            self.rows = []
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.line = []

    def handle_endtag(self, tag) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip or tag in VOID:
            return
        if tag in ("strong", "b"):
            self.line.append("**")
        elif tag in ("em", "i"):
            self.line.append("*")
        elif tag == "a":
            self.line.append(f"]({self.href or ''})")
            self.href = None
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(" ".join("".join(self.line).split()).replace("|", "\\|"))
            self.line = []
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.rows:
            wide = max(map(len, self.rows))
            cells = [r + [""] * (wide - len(r)) for r in self.rows]
            self.blocks.append("\n".join("| " + " | ".join(r) + " |" for r in [cells[0], ["---"] * wide, *cells[1:]]))
            self.rows = []
        else:
            if tag in BLOCKS:
                self.flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()

    def handle_data(self, data) -> None:
        if not self.skip:
            self.line.append(data)


def to_markdown_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n\n".join(parser.blocks)


@pandas_udf(StringType())
def _converted(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(to_markdown_text)


def to_markdown(html: Column | str) -> Column:
    """Markdown of each page, in Arrow batches of bounded size."""
    small_batches(SparkSession.active())
    return _converted(html)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))


def features(html: Column) -> dict[str, Column]:
    """Counts of what the Markdown will hold."""
    count = lambda pattern: F.regexp_count(html, F.lit(pattern))
    return {"n_tables": count(r"<table\b"), "n_links": count(r"<a\s"), "n_headings": count(r"<h[1-6]\b"), "n_items": count(r"<li\b"), "n_images": count(r"<img\b")}
