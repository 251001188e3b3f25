"""The queries of the engine: name -> callable over (spark, directory of tables), and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Modules that register queries.
PLANS = ("graph", "traversal", "history", "timing", "infrastructure", "scoring", "resolution", "quality", "reports", "leads", "loading", "records", "streams", "lookup", "review")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its SQL where SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _load() -> None:
    for name in PLANS:
        import_module(f"orrery.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
