"""Compares a query with its SQL as the driver does: column names, rows, values."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "~"
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if v == int(v) else f"{v:.9g}"
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    frame = con.sql(sql).df()
    return sorted(frame.columns), rows(frame)
