"""Queries by name, and the same as SQL for another engine."""

from __future__ import annotations

from importlib import import_module

#: In the order in which their queries are listed.
MODULES = ("features", "learning", "problems")


def catalogue(modules: list) -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for m in modules:
        if again := queries.keys() & m.QUERIES.keys():
            raise ValueError(f"named twice: {again}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql


def core_modules() -> list:
    return [import_module(f"millrace.queries.{m}") for m in MODULES]
