"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame``.  The oracle is an
independent ANSI-SQL statement over the same parquet tables; queries with no
SQL form register ``sql=None`` and are checked on row counts only.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

# Modules holding ``@query`` definitions, in build order.
_MODULES = (
    "quill.plans.q_text",
    "quill.plans.q_results",
    "quill.plans.q_reports",
    "quill.plans.q_eval",
    "quill.plans.q_monitor",
    "quill.plans.q_features",
    "quill.plans.q_stream",
    "quill.plans.q_sources",
    "quill.plans.q_train",
)


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict[str, QueryFn]:
    _load()
    return {k: v[0] for k, v in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in _REGISTRY.items() if v[1]}
