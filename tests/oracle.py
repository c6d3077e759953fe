"""Compares a query's rows with those of its SQL twin in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"create view {path.stem} as select * from '{source}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def value(x):
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
            return tuple(value(y) for y in x)
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "item"):
            x = x.item()
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    rows = [tuple(value(x) for x in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    """Empty if both have the same rows."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(sql_rows.columns)}"
    a, b = canonical(spark_rows), canonical(sql_rows)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    odd = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(odd)} of {len(a)} rows differ: {odd[0]}" if odd else ""
