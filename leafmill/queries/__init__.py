"""Registered queries of the core, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, folder) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    """All queries and all SQL of the core."""
    from leafmill.queries import reference, study  # noqa: F401

    return dict(QUERIES), dict(SQL)
