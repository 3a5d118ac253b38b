"""Text of office files from their XML: one row of a binary column in, Markdown and facts out.

DOCX, XLSX and PPTX are archives of XML, so the standard library reads them. PDF and
images need libraries that are not installed; they come out with a warning and no
text, unless a provider is given.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

ROWS = 1000
SCHEMA = "path string, kind string, markdown string, n_tables int, n_footnotes int, n_comments int, n_parts int, warning string"
_NAME = re.compile(r"^\{[^}]*\}")


def _tag(node) -> str:
    return _NAME.sub("", node.tag)


def _attr(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _NAME.sub("", k) == name), None)


def _all(node, tag: str) -> list:
    return [x for x in node.iter() if _tag(x) == tag]


def _xml(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _links(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    found = _xml(archive, f"{folder}/_rels/{name}.rels")
    return {} if found is None else {r.attrib["Id"]: r.attrib["Target"] for r in found}


def _table(rows: list[list[str]]) -> str:
    wide = max((len(r) for r in rows), default=0)
    cells = [[c.replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (wide - len(r)) for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [cells[0], ["---"] * wide, *cells[1:]]) if cells and wide else ""


def _run(node) -> str:
    text = "".join(x.text or "" if _tag(x) == "t" else "\t" if _tag(x) == "tab" else "" for x in node.iter())
    marks = {_tag(x) for p in node if _tag(p) == "rPr" for x in p if _attr(x, "val") not in ("0", "false")}
    mark = ("**" if "b" in marks else "") + ("*" if "i" in marks else "")
    notes = "".join(f"[^{_attr(x, 'id')}]" for x in node if _tag(x) == "footnoteReference")
    return (f"{mark}{text}{mark[::-1]}" if text.strip() else text) + notes


def _paragraph(node, links: dict[str, str]) -> str:
    out, style, level = [], "", None
    for x in node:
        if _tag(x) == "pPr":
            style = next((_attr(s, "val") or "" for s in x if _tag(s) == "pStyle"), "")
            level = next((int(_attr(v, "val") or 0) for s in x if _tag(s) == "numPr" for v in s if _tag(v) == "ilvl"), None)
        elif _tag(x) == "r":
            out.append(_run(x))
        elif _tag(x) == "hyperlink":
            text = "".join(_run(r) for r in x if _tag(r) == "r")
            out.append(f"[{text}]({links.get(_attr(x, 'id') or '', '')})")
    text = "".join(out).strip()
    if not text:
        return ""
    if found := re.fullmatch(r"[Hh]eading\s?([1-6])", style):
        return "#" * int(found[1]) + " " + text
    return "  " * level + "- " + text if level is not None else text


def docx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = _xml(archive, "word/document.xml")
        links = _links(archive, "word/document.xml")
        blocks, tables = [], 0
        for node in root[0]:
            if _tag(node) == "p":
                blocks.append(_paragraph(node, links))
            elif _tag(node) == "tbl":
                tables += 1
                blocks.append(_table([[" ".join(filter(None, (_paragraph(p, links) for p in _all(cell, "p")))) for cell in row if _tag(cell) == "tc"] for row in node if _tag(row) == "tr"]))
        notes = _xml(archive, "word/footnotes.xml")
        held = [] if notes is None else [(_attr(n, "id"), "".join(t.text or "" for t in _all(n, "t"))) for n in notes if _attr(n, "type") is None]
        blocks += [f"[^{i}]: {t.strip()}" for i, t in held]
        said = _xml(archive, "word/comments.xml")
        comments = [] if said is None else [(_attr(c, "author") or "", "".join(t.text or "" for t in _all(c, "t"))) for c in said]
        if comments:
            blocks += ["## Comments", *[f"- {who}: {what}" for who, what in comments]]
    return {"markdown": "\n\n".join(filter(None, blocks)), "n_tables": tables, "n_footnotes": len(held), "n_comments": len(comments), "n_parts": 1}


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def real_header(cells: list[tuple[str, str]]) -> bool:
    """Whether a first row of (text, kind) is a header: all that is not empty is a string and no formula."""
    full = [(t, k) for t, k in cells if t]
    return bool(full) and all(k == "string" and not t.startswith("=") for t, k in full)


def xlsx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        shared = _xml(archive, "xl/sharedStrings.xml")
        texts = [] if shared is None else ["".join(t.text or "" for t in _all(s, "t")) for s in shared]
        links, blocks = _links(archive, "xl/workbook.xml"), []
        sheets = _all(_xml(archive, "xl/workbook.xml"), "sheet")
        for sheet in sheets:
            root = _xml(archive, posixpath.normpath(posixpath.join("xl", links[_attr(sheet, "id")].lstrip("/").removeprefix("xl/"))))
            rows: list[dict[int, tuple[str, str]]] = []
            formulas = []
            for row in _all(root, "row"):
                cells = {}
                for c in row:
                    kind, value = c.attrib.get("t", "n"), next((x.text or "" for x in c if _tag(x) == "v"), "")
                    formula = next((x.text for x in c if _tag(x) == "f"), None)
                    if kind == "s":
                        value, kind = texts[int(value)], "string"
                    elif kind == "inlineStr":
                        value, kind = "".join(t.text or "" for t in _all(c, "t")), "string"
                    elif kind == "str":
                        kind = "string"
                    if formula:
                        formulas.append(f"{c.attrib['r']}: ={formula}")
                        value, kind = value, "formula"
                    cells[column_number(c.attrib["r"])] = (value, kind)
                rows.append(cells)
            wide = max((max(r, default=0) for r in rows), default=0)
            grid = [[r.get(i, ("", "empty")) for i in range(1, wide + 1)] for r in rows]
            own = bool(grid) and real_header(grid[0])
            head = [t for t, _ in grid[0]] if own else [letters(i) for i in range(1, wide + 1)]
            body = grid[1:] if own else grid
            blocks += [f"## {_attr(sheet, 'name')}", _table([head, *[[t for t, _ in r] for r in body[:ROWS]]]) if grid else ""]
            if len(body) > ROWS:
                blocks.append(f"*{len(body) - ROWS} more rows*")
            merged = [m.attrib["ref"] for m in _all(root, "mergeCell")]
            blocks += ["Merged: " + ", ".join(merged)] * bool(merged) + ["Formulas: " + "; ".join(formulas)] * bool(formulas)
    return {"markdown": "\n\n".join(filter(None, blocks)), "n_tables": len(sheets), "n_footnotes": 0, "n_comments": 0, "n_parts": len(sheets)}


def pptx(data: bytes) -> dict:
    """Slides in order; shapes by title first, then rows of the page, then from the left; notes last."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        blocks, tables = [], 0
        for number, name in enumerate(names, 1):
            root, shapes, title = _xml(archive, name), [], ""
            for shape in [x for x in root.iter() if _tag(x) in ("sp", "graphicFrame")]:
                at = next(iter(_all(shape, "off")), None)
                x, y = (int(at.attrib["x"]), int(at.attrib["y"])) if at is not None else (0, 0)
                kind = next((p.attrib.get("type", "") for p in _all(shape, "ph")), "")
                lines = ["".join(t.text or "" for t in _all(p, "t")) for p in _all(shape, "p")]
                if _tag(shape) == "graphicFrame" and _all(shape, "tbl"):
                    tables += 1
                    text = _table([[" ".join("".join(t.text or "" for t in _all(p, "t")) for p in _all(cell, "p")) for cell in row if _tag(cell) == "tc"] for row in _all(shape, "tr")])
                else:
                    text = "\n".join(x for x in lines if x.strip())
                if kind in ("title", "ctrTitle") and not title:
                    title = text
                elif text:
                    shapes.append((y // 500_000, x, text))
            blocks += [f"## Slide {number}" + (f" - {title}" if title else ""), *[t for _, _, t in sorted(shapes)]]
            notes = _xml(archive, f"ppt/notesSlides/notesSlide{number}.xml")
            if notes is not None and (said := "\n".join("".join(t.text or "" for t in _all(p, "t")) for p in _all(notes, "p")).strip()):
                blocks.append(f"> Notes: {said}")
    return {"markdown": "\n\n".join(blocks), "n_tables": tables, "n_footnotes": 0, "n_comments": 0, "n_parts": len(names)}


READERS: dict[str, Callable[[bytes], dict]] = {"docx": docx, "xlsx": xlsx, "pptx": pptx}


def extract(files: DataFrame, providers: dict[str, Callable[[bytes], dict]] | None = None) -> DataFrame:
    """A row (see SCHEMA) for each file (path, content), by extension; an unknown one or one that cannot be read gets a warning."""
    readers = READERS | (providers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch.path, batch.content, strict=True):
                kind = path.rpartition(".")[2].lower()
                row = {"path": path, "kind": kind, "markdown": None, "n_tables": 0, "n_footnotes": 0, "n_comments": 0, "n_parts": 0, "warning": None}
                if kind not in readers:
                    row["warning"] = "no_provider" if kind in ("pdf", "png", "jpg", "jpeg") else "unsupported_file_type"
                else:
                    try:
                        row |= readers[kind](bytes(content))
                    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, AttributeError, TypeError) as e:
                        row["warning"] = f"unreadable: {type(e).__name__}"
                out.append(row)
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)
