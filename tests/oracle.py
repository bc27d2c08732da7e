"""Compares a Spark query with its DuckDB SQL on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def normal(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same(df, sql: str, connection) -> None:
    result = connection.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(result.columns)
    at = [result.columns.index(x) for x in names]
    got = Counter(tuple(normal(r[x]) for x in names) for r in df.collect())
    want = Counter(tuple(normal(r[i]) for i in at) for r in result.fetchall())
    assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])
