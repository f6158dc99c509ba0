"""Pairs of a Spark query and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.functions.values import round_half_even

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator's key, with its SQL where there is one."""

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Registered twice: {name}")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def shown(ts: Column) -> Column:
    """Timestamps are compared as text with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(value: Column | str) -> Column:
    """Averages and sums of doubles are compared at six places."""
    return round_half_even(F.col(value) if isinstance(value, str) else value, 6)
