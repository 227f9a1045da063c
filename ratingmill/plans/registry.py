"""Registered queries over the derived tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = run
    if sql is not None:
        _SQL[name] = sql


def _load() -> None:
    from ratingmill.plans import feeds, games, ratings, windows  # noqa: F401  register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
