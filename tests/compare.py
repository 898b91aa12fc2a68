"""Rows of a Spark frame and of DuckDB in one comparable form."""

import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def _cell(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return ""
    if isinstance(x, float):
        return f"{x:.6g}"
    if hasattr(x, "__len__") and not isinstance(x, str):
        return str(list(x))
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))
