"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.session import tune

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def keep(fn: QueryFn) -> QueryFn:
        @functools.wraps(fn)
        def tuned(spark: SparkSession, sf: str) -> DataFrame:
            return fn(tune(spark), sf)

        QUERIES[name] = tuned
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def r6(c: Column | str, name: str) -> Column:
    """Rounded for comparison; six digits on both sides."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def load() -> None:
    from paceforge.plans import queries_cleaning, queries_flow, queries_history, queries_models, queries_trends  # noqa: F401
