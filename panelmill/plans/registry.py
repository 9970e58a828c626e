"""Registry of named queries and their DuckDB twins.

Each query is ``fn(spark, sf_dir) -> DataFrame`` and reads the provided
tables (or what Spark derives from them). ``sql`` is the equivalent DuckDB
SQL over the same tables; ``None`` marks a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def load_all() -> None:
    """Import every plan module so its queries register."""
    import importlib
    for mod in PLAN_MODULES:
        importlib.import_module(f"panelmill.plans.{mod}")


PLAN_MODULES = ["q_features", "q_joins", "q_metrics", "q_policy", "q_uncertainty", "q_regression", "q_sources", "q_aggregates", "q_models", "q_series", "q_chain"]
