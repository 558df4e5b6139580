"""Registered queries by id, each with the DuckDB SQL that it must equal (or none).

A query function takes ``Tables``; its SQL may name the domain views of ``dossier.views``, whose
definitions are put before it.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.views import VIEW_SQL, Tables

FLAGSHIP = "pl_explore_issue"
CATALOGS = ["ingestion", "filtering", "texts", "linking", "aggregation", "ordering", "searching", "lifecycle", "evidence", "streams", "pipelines"]

_found: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function under ``name``."""

    def keep(f: Callable[[Tables], DataFrame]):
        _found[name] = (f, sql)
        return f

    return keep


def _load() -> None:
    for name in CATALOGS:
        importlib.import_module(f"dossier.catalog.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in _found.items()}


def with_views(sql: str) -> str:
    """``sql`` with the views that it names, directly or through others, as leading CTEs."""
    needed: list[str] = []

    def need(text: str) -> None:
        for view, body in VIEW_SQL.items():
            if view not in needed and re.search(rf"\b{view}\b", text):
                need(body)
                needed.append(view)

    need(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in needed)
    rest = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql)
    return f"WITH {ctes}{', ' if rest != sql else ' '}{rest}"


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_views(sql) for name, (_, sql) in _found.items() if sql}
