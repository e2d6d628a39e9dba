"""Registry of named queries: each has a Spark builder ``fn(spark, sf_dir)``
and, when the operator is SQL-expressible, the DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a query under ``name`` with an optional oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their registrations run."""
    from bandcast.plans import (q_core, q_features, q_spatial, q_eval, q_sampling,  # noqa: F401
                                q_ingest, q_lifecycle, q_ml, q_streaming, q_tables)
