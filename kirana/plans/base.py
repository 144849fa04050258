"""Registry plumbing: each named query is a Spark plan builder plus an
optional DuckDB oracle SQL string over the raw parquet views."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from kirana.plans.oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    key: str
    build: Builder
    sql: str | None = None
    note: str = ""


REGISTRY: dict[str, Query] = {}

TODAY = "2001-08-01"


def query(key: str, sql: str | None = None, ctes: dict[str, str] | None = None, note: str = ""):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""
    def deco(fn: Builder) -> Builder:
        REGISTRY[key] = Query(key, fn, with_views(sql, ctes) if sql else None, note)
        return fn
    return deco
