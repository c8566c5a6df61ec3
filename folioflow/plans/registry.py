"""Where plans register as queries by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a table reader: t("orders") is a DataFrame."""

    def add(f):
        QUERIES[name] = lambda spark, folder: f(lambda t: table(spark, folder, t))
        if sql:
            SQL[name] = sql
        return f

    return add
