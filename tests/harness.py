"""Runs queries in Spark and their SQL in DuckDB over the same tables, and compares them as the driver does."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else (v + 0.0 if isinstance(v, float) else v.item() if hasattr(v, "item") else v)
    return sorted((tuple(clean(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=repr)


def differences(got: pd.DataFrame, want: pd.DataFrame, n: int = 4) -> str:
    """Empty if rows and columns agree."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a == b:
        return ""
    left, right = [x for x in a if x not in set(b)][:n], [x for x in b if x not in set(a)][:n]
    return f"{len(a)} and {len(b)} rows; only here {left}; only there {right}"
