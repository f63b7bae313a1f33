"""Run a query and its SQL on the same tables and compare columns, rows and values."""

from __future__ import annotations

import datetime as dt
import decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _kind(value) -> str:
    kinds = {decimal.Decimal: "float", bool: "bool"}
    return kinds.get(type(value), type(value).__name__)


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    lines = [tuple(_plain(row[i]) for i in order) for row in rows]
    kinds = [{_kind(row[i]) for row in rows if row[i] is not None} for i in order]
    return [names[i] for i in order], kinds, sorted(lines, key=repr)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    found = _table(df.columns, [tuple(row) for row in df.collect()])
    answer = con.execute(sql)
    names = [column[0] for column in answer.description]
    expected = _table(names, answer.fetchall())
    if found[0] != expected[0]:
        return f"columns {found[0]} but {expected[0]} expected"
    if found[1] != expected[1]:
        kinds = list(zip(found[0], found[1], expected[1], strict=True))
        return f"types {[k for k in kinds if k[1] != k[2]]}"
    if len(found[2]) != len(expected[2]):
        return f"{len(found[2])} rows but {len(expected[2])} expected"
    wrong = [(a, b) for a, b in zip(found[2], expected[2], strict=True) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0][0]} but {wrong[0][1]} expected"
    return None
