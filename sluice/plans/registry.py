"""All queries of the engine by name, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_PLANS = ("text", "pages", "screening", "dedup", "retrieval", "evidence", "sufficiency", "claims", "evaluation", "judging", "relational", "files", "stream")


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the same in SQL."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for plan in _PLANS:
        importlib.import_module(f"{__package__}.{plan}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
