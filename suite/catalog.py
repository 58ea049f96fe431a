"""All queries and their checking SQL, gathered from the topic modules."""

from __future__ import annotations

import importlib

TOPICS = ("feeds", "landed", "scalars", "gating", "joined", "totals", "merges", "pagejobs", "planned", "streams")


def _modules():
    return [importlib.import_module(f"suite.{name}") for name in TOPICS]


def queries() -> dict:
    return {key: query for m in _modules() for key, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: text for m in _modules() for key, text in m.ORACLE.items()}
