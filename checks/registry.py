"""Register a Spark query together with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    """A named subquery for the DuckDB side."""
    VIEWS[name] = (sql, needs)


def with_views(body: str, names) -> str:
    """``WITH`` clause of the named subqueries and everything they need, then the body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][1]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    clauses = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][0]})" for n in ordered)
    return f"WITH {clauses}\n{body}" if ordered else body


def query(name: str, sql: str | None = None, views=()):
    """Decorator: the function becomes query ``name``; ``sql`` is its DuckDB twin."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return register
