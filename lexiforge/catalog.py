"""Every query of the library with the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS = ("retrieval", "elements", "state", "evaluation", "chunks", "routing", "building", "live", "publication")
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers fn(spark, sf_dir) under name, with DuckDB SQL for the same rows if there is any."""

    def add(fn):
        if name in _queries:
            raise ValueError(f"duplicate query {name}")
        _queries[name] = fn
        if oracle:
            _oracles[name] = oracle
        return fn

    return add


def as_int(column: str, sql: str) -> str:
    """sql with one column cast to INT: ranks are INT in Spark and BIGINT in DuckDB."""
    return f"SELECT * REPLACE ({column}::INT AS {column}) FROM ({sql})"


def _load() -> None:
    """Imports the modules that register queries."""
    for name in PLANS:
        importlib.import_module(f"{__package__}.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _queries


def oracles() -> dict[str, str]:
    _load()
    return _oracles


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoped multi-query retrieval with rank fusion."""
    return queries()["Q22_single_query_retrieve"](spark, sf_dir)
