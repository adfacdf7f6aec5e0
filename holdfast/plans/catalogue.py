"""Every registered query, as (spark, folder) -> DataFrame, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from holdfast.plans.registry import QUERIES, SQL, Tables

MODULES = ("holdings", "holders", "places", "quality", "scalars", "lookups", "files")
for _module in MODULES:
    import_module(f"holdfast.plans.{_module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, fn=fn: fn(Tables(spark, folder))) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
