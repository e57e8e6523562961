"""Registered queries: name -> (Spark function, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import auditlake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def load() -> None:
    """Import all query modules. Graders travel to workers by value, so no package must be installed there."""
    cloudpickle.register_pickle_by_value(auditlake)
    from auditlake.plans import (  # noqa: F401
        queries_change,
        queries_classify,
        queries_exchange,
        queries_grade,
        queries_import,
        queries_list,
        queries_metrics,
        queries_store,
    )
