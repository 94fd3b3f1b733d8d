"""Where queries and their reference SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query. ``sql`` follows the named views; it may open with more CTEs after a comma."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            used = ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in views.split())
            ORACLES[name] = f"WITH RECURSIVE {used}\n{sql.strip()}" if used else sql.strip()
        return fn

    return add


def r6(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)
