"""Registry of the named queries and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("scans", "filters", "joins", "aggregates", "windows", "possession", "sets", "scalars", "domain", "whatif", "updates", "models", "streams")

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name (or ``name``) with its DuckDB SQL, if SQL can express it."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        _queries[key] = f
        if sql is not None:
            _oracles[key] = sql
        return f

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"shiftframe.plans.{module}")


def queries() -> dict[str, Query]:
    """Every query of the analytics part, by name."""
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """The DuckDB text of every query that SQL can express."""
    _load()
    return dict(_oracles)
