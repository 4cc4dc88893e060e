"""Registered queries and the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``, with its statement for the check."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived(spark: SparkSession, folder: str, statement: str, *tables: str) -> DataFrame:
    """Rows of a SELECT over the named tables, which it mentions as {name}; other braces are doubled."""
    return spark.sql(statement, **{name: table(spark, folder, name) for name in tables})


class _Names(dict):
    def __missing__(self, name: str) -> str:
        return name


def plain(statement: str) -> str:
    """The same SELECT for an engine that knows the tables by name."""
    return statement.format_map(_Names())
