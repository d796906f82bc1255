"""The registered queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODULES = ("scalar_queries", "search_queries", "graph_queries", "report_queries", "source_queries")


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with its SQL for DuckDB if there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lodestone.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLE
