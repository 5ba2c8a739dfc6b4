"""Names of the registered queries, their functions and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "ranking_metrics"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the decorated function under its own name; ``sql`` gives the same rows in DuckDB."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def load() -> None:
    """Imports the plans, which register their queries."""
    import importlib

    for name in ("evaluation", "retrieval", "corpus", "quality", "events", "records", "structure"):
        importlib.import_module(f"quillstone.plans.{name}")


load()
