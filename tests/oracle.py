"""Comparing a query with its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v: object) -> object:
    if isinstance(v, (list, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or (not isinstance(v, str) and pd.isna(v)):
        return None
    if isinstance(v, (float, np.floating)):
        v = round(float(v), 6)
        return int(v) if v == int(v) else v
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
