"""The registry of queries: each has a name, a DataFrame plan and, where SQL can express it, the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under its function's name, or under `name`."""

    def add(function: Plan) -> Plan:
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = function
        if sql:
            SQL[key] = sql
        return function

    return add


def queries() -> dict[str, Plan]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def _load() -> None:
    from . import fits, graphs, metrics, pairings, replay, reports, scalars, scoring, selection  # noqa: F401  (their queries register on import)
