"""The query catalogue: every query of the engine with the SQL that checks it."""

from __future__ import annotations

import importlib

MODULES = ("q_ingest", "q_views", "q_graph", "q_text", "q_retrieval", "q_hygiene", "q_lint", "q_reports", "q_streaming")


def _all() -> dict:
    found: dict = {}
    for name in MODULES:
        more = importlib.import_module(f"vellum.plans.{name}").QUERIES
        if clash := found.keys() & more.keys():
            raise ValueError(f"query names repeat: {clash}")
        found |= more
    return found


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
