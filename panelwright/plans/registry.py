"""Registration of queries next to the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.plans.panels import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_tables(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` after common table expressions, by name and in order."""
    extra = extra or {}
    parts = [f"{n} AS ({extra.get(n) or SQL[n]})" for n in names.split()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


def whole(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)
