"""Runs registered queries and their SQL side by side and compares the values."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def in_order(columns: list[str], rows: list) -> list[tuple]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when both sides agree on columns and values."""
    got = df.collect()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    a, b = in_order(df.columns, got), in_order(names, want)
    if len(a) != len(b):
        return [f"{len(a)} rows != {len(b)}"]
    return [f"{x} != {y}" for x, y in zip(a, b) if x != y][:3]
