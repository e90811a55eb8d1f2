"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


def _load() -> None:
    from eventloom.plans import load

    load()


_load()
