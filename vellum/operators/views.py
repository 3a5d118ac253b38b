"""Saved views: filter trees compiled to columns, bitemporal filters, schema checks."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLAUSE = re.compile(r"^\s*(?:note\.)?([\w.]+)\s*(==|!=|<=|>=|<|>)\s*(.+?)\s*$")


def _literal(text: str) -> Any:
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    return float(text) if "." in text else int(text)


def _compare(name: str, op: str, value: Any) -> Column:
    """A missing field is the empty string beside a string, unequal to a boolean, and outside every order."""
    x = F.col(name)
    if isinstance(value, bool):
        same = x.eqNullSafe(F.lit(value))
        return {"==": same, "!=": ~same}[op]
    if isinstance(value, str) and op in ("==", "!="):
        same = F.coalesce(x.cast("string"), F.lit("")) == value
        return same if op == "==" else ~same
    ordered = {"==": x == value, "!=": x != value, "<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}
    return F.coalesce(ordered[op], F.lit(False))


def compile_filter(tree: Any) -> Column:
    """A tree of ``and``, ``or`` and ``not`` over clauses ``field op literal`` as one boolean column."""
    if tree is None:
        return F.lit(True)
    if isinstance(tree, str):
        found = _CLAUSE.match(tree)
        if not found:
            raise ValueError(f"not a clause: {tree!r}")
        return _compare(found[1], found[2], _literal(found[3]))
    if isinstance(tree, dict) and len(tree) == 1:
        (kind, parts), *_ = tree.items()
        parts = [compile_filter(p) for p in (parts if isinstance(parts, list) else [parts])]
        if kind == "and":
            return reduce(Column.__and__, parts, F.lit(True))
        if kind == "or":
            return reduce(Column.__or__, parts, F.lit(False))
        if kind == "not":
            return ~reduce(Column.__or__, parts, F.lit(False))
    raise ValueError(f"not a filter: {tree!r}")


def fields_of(tree: Any) -> list[str]:
    """Fields named in a filter tree, in order of appearance."""
    if isinstance(tree, str):
        found = _CLAUSE.match(tree)
        return [found[1]] if found else []
    parts = tree if isinstance(tree, list) else list(tree.values()) if isinstance(tree, dict) else []
    return list(dict.fromkeys(f for p in parts for f in fields_of(p)))


def bound_types(tree: Any) -> list[str]:
    """Literals of ``type == "x"`` clauses in a tree."""
    if isinstance(tree, str):
        found = re.match(r"""^\s*(?:note\.)?type\s*==\s*["'](\w+)["']\s*$""", tree)
        return [found[1]] if found else []
    parts = tree if isinstance(tree, list) else list(tree.values()) if isinstance(tree, dict) else []
    return list(dict.fromkeys(t for p in parts for t in bound_types(p)))


def is_primary(tree: Any) -> bool:
    """Whether a base binds a schema: its filter is exactly one clause ``type == "x"``."""
    clauses = [tree] if isinstance(tree, str) else tree.get("and", []) if isinstance(tree, dict) else []
    return len(clauses) == 1 and isinstance(clauses[0], str) and len(bound_types(clauses[0])) == 1


def required_keys(base: dict) -> list[str]:
    """Fields that the views of a base use, but for ``type`` and ``file.*``."""
    found = fields_of(base.get("filters"))
    for view in base.get("views", []):
        found += fields_of(view.get("filters"))
        found += [o["property"] for o in view.get("order", [])]
        found += [view["groupBy"]["property"]] if view.get("groupBy") else []
    return sorted({f.removeprefix("note.") for f in found if f != "type" and not f.startswith("file.")})


def contracts(specs: DataFrame) -> DataFrame:
    """(base, required, types, is_primary, view_only) of a table of ``specs`` (base, spec as JSON): what each base asks of its notes.

    A base that names no type binds no schema and is only looked at. What is no JSON
    object asks for nothing.
    """
    import json
    from collections.abc import Iterator

    import pandas as pd

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for base, text in zip(batch["base"], batch["spec"], strict=True):
                try:
                    spec = json.loads(text or "")
                except ValueError:
                    spec = {}
                spec = spec if isinstance(spec, dict) else {}
                types = bound_types(spec.get("filters"))
                rows.append((base, required_keys(spec), types, is_primary(spec.get("filters")), not types))
            yield pd.DataFrame(rows, columns=["base", "required", "types", "is_primary", "view_only"])

    return specs.select("base", "spec").mapInPandas(read, "base string, required array<string>, types array<string>, is_primary boolean, view_only boolean")


def view(notes: DataFrame, base: dict, name: str) -> DataFrame:
    """Rows of a named view: the base's and the view's filter, its order with all ties broken, its limit."""
    spec = next(v for v in base["views"] if v["name"] == name)
    out = notes.where(compile_filter(base.get("filters")) & compile_filter(spec.get("filters")))
    group = [F.asc_nulls_last(spec["groupBy"]["property"])] if spec.get("groupBy") else []
    order = [F.desc_nulls_last(o["property"]) if o.get("direction", "ASC").upper() == "DESC" else F.asc_nulls_last(o["property"]) for o in spec.get("order", [])]
    if group or order:
        out = out.orderBy(*group, *order, *spec.get("tiebreak", []))
    return out.limit(spec["limit"]) if spec.get("limit") else out


def latest_only(notes: DataFrame, flag: str = "is_latest_version") -> DataFrame:
    """Missing counts as latest."""
    return notes.where(~F.col(flag).eqNullSafe(F.lit(False)))


def as_of(notes: DataFrame, day: str, since: str = "document_date", until: str = "superseded_date") -> DataFrame:
    """Rows valid on a day: from ``since``, before ``until`` if there is one."""
    at = F.lit(day).cast("date")
    return notes.where((F.col(since) <= at) & (F.col(until).isNull() | (F.col(until) > at)))


def missing_keys(notes: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """A row (path, type, missing_key) for each required key that is null, blank or an empty list."""

    def lacks(key: str) -> Column:
        x, kind = F.col(key), dict(notes.dtypes)[key]
        if kind.startswith("array"):
            return x.isNull() | (F.size(x) == 0)
        return x.isNull() | (F.trim(x.cast("string")) == "")

    checks = [F.when((F.col("type") == t) & lacks(k), F.lit(k)) for t, keys in required.items() for k in keys]
    return notes.select("path", "type", F.explode(F.filter(F.array(*checks), lambda k: k.isNotNull())).alias("missing_key"))
