"""Run a registered query and its statement on the same tables and compare them as row sets."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime().replace(tzinfo=None)
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(_plain(v) for v in value)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in value.items())
    if hasattr(value, "item"):
        return _plain(value.item())
    if type(value).__name__ == "Decimal":
        return float(value)
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if hasattr(value, "replace") and hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def _key(row: tuple) -> tuple:
    return tuple((v is not None, type(v).__name__, repr(v)) for v in row)


def rowset(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=_key)


def difference(spark, con, run, statement: str, folder: str) -> str | None:
    df = run(spark, folder)
    got = rowset(df.columns, df.collect())
    result = con.execute(statement)
    want = rowset([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}; only here {[r for r in got[1] if r not in set(want[1])][:3]}; only there {[r for r in want[1] if r not in set(got[1])][:3]}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)} rows differ, e.g. {bad[:3]}" if bad else None
