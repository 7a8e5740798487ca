"""Registry of queries and their reference SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries.
MODULES = ("gold", "reconcile", "history", "market", "reports", "scoring", "streams", "features", "files", "pages", "boards", "bundles", "boxscores")
FLAGSHIP = "prior_form_head_to_head"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Decorator: register a query (spark, sf_dir) and the DuckDB SQL that must give the same rows."""

    def register(f):
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"arenalake.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
