"""Texts that occur many times, worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, column: str, name: str, work: Callable[[Column], Column], keep: Callable[[DataFrame], DataFrame] = lambda told: told) -> DataFrame:
    """``df`` with ``name``: what ``work`` makes of the column, computed per distinct value and joined back.

    Tasks meet the distinct values of their rows first, so a value costs one computation however many rows have it, and
    a null is a value like any other. ``keep`` may write the table of distinct values, for work that is dear and used twice.
    """
    told = keep(df.select(F.col(column).alias("_value")).distinct().select("_value", work(F.col("_value")).alias(name)))
    return df.join(told, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")
