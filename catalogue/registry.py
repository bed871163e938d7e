"""Registry of bound queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalogue.tables import Tables
from shelfscope.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def bind(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under a name, with its SQL counterpart."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return build(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register
