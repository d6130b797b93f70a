"""All queries of the library's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
MODULES = ("text_queries", "catalog_queries", "index_queries", "retrieval_queries")


def query(sql: str | None, name: str | None = None) -> Callable:
    """Enters a query (spark, sf_dir) -> DataFrame under its name, with its SQL if SQL can express it."""

    def enter(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return enter


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
