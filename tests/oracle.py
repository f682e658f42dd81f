"""Compare registered queries with their SQL on one scale factor, in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(frame) -> list[tuple]:
    def plain(x):
        if pd.isna(x):
            return "null"
        return f"{float(x):.5f}".replace("-0.00000", "0.00000") if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__module__ == "numpy" and hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)

    names = sorted(frame.columns)
    return sorted(tuple(plain(x) for x in r) for r in frame[names].astype(object).itertuples(index=False))
