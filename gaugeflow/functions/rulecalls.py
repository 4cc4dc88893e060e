"""Finding the ``status.get(sensor, time, statistic)`` calls in rule text."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The call shapes looked for in rule text.
CALL = r"status\.get\(([^)]+)\)"
CALL_SENSOR = r"status\.get\([\"']([^\"']+)[\"']"
QUOTED = r"[\"']([^\"']+)[\"']"
ARGUMENT = r"^\s*(?:\"([^\"]*)\"|'([^']*)')\s*$"

ANALYSIS = "struct<syntax_ok: boolean, calls: array<struct<sensor_id: string, time_expression: string, statistic: string>>>"


def call_sensors(body: Column) -> Column:
    """First quoted argument of every call, in text order."""
    return F.regexp_extract_all(body, F.lit(CALL_SENSOR), F.lit(1))


def call_arguments(body: Column) -> Column:
    """Argument text of every call, in text order."""
    return F.regexp_extract_all(body, F.lit(CALL), F.lit(1))


def quoted(arguments: Column) -> Column:
    """Quoted strings in an argument text."""
    return F.regexp_extract_all(arguments, F.lit(QUOTED), F.lit(1))


def _constant(arguments: Column, position: int) -> Column:
    # A positional argument counts only when it is a single string constant.
    raw = F.get(F.split(arguments, ","), F.lit(position))
    text = F.concat(F.regexp_extract(raw, ARGUMENT, 1), F.regexp_extract(raw, ARGUMENT, 2))
    return F.when(raw.rlike(ARGUMENT), text)


def calls(rules: DataFrame, body: str = "rule_body", keys: tuple[str, ...] = ("rule_id",)) -> DataFrame:
    """One row per call: keys, call_idx, sensor_id, time_expression, statistic.

    Works on text alone, inside the JVM. Use ``analyse`` where comments, nested calls or commas
    inside the constants may occur.
    """
    found = rules.select(*keys, F.posexplode(call_arguments(F.col(body))).alias("call_idx", "arguments"))
    args = F.col("arguments")
    return found.select(
        *keys,
        "call_idx",
        _constant(args, 0).alias("sensor_id"),
        _constant(args, 1).alias("time_expression"),
        _constant(args, 2).alias("statistic"),
    )


def _read_calls(body: str | None) -> dict:
    try:
        tree = ast.parse(body or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last two: nested too deeply to parse
        return {"syntax_ok": False, "calls": []}
    found = []
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        if node.__class__ is ast.Call:
            target = node.func
            if isinstance(target, ast.Attribute) and target.attr == "get" and getattr(target.value, "id", None) == "status":
                values = [str(a.value) if isinstance(a, ast.Constant) and a.value is not None else None for a in node.args[:3]]
                found.append(dict(zip(("sensor_id", "time_expression", "statistic"), values + [None] * 3)))
        below: list = []
        for name in node._fields:
            child = getattr(node, name, None)
            if isinstance(child, list):
                below += [c for c in child if isinstance(c, ast.AST)]
            elif isinstance(child, ast.AST):
                below.append(child)
        waiting += reversed(below)
    return {"syntax_ok": True, "calls": found}


def analyse(body: Column | str) -> Column:
    """Whether the text is valid Python and the calls it makes, in syntax-tree order."""

    def read(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read_calls(b) for b in bodies], columns=["syntax_ok", "calls"])

    # called deterministic, it would run a second time as a filter below an explode, within the tasks of the scan
    return F.pandas_udf(read, ANALYSIS).asNondeterministic()(body)


def requirements(rules: DataFrame, body: str = "rule_body") -> DataFrame:
    """Distinct (sensor_id, time_expression, statistic) over all rules; a rule that does not parse has none."""
    return (
        rules.select(body)
        .distinct()  # each text is parsed once
        .select(F.explode(analyse(body)["calls"]).alias("call"))
        .select("call.*")
        .where(F.col("sensor_id").isNotNull() & (F.col("sensor_id") != ""))
        .where(F.col("time_expression").isNotNull() & (F.col("time_expression") != ""))
        .select("sensor_id", "time_expression", "statistic")
        .distinct()
    )


def sensor_set(body: Column) -> Column:
    """Sorted distinct sensors a rule reads; none for a text that does not parse."""
    sensors = F.transform(analyse(body)["calls"], lambda call: call["sensor_id"])
    return F.array_sort(F.array_distinct(F.filter(sensors, lambda s: s.isNotNull() & (s != ""))))
