"""Runs a query and its SQL twin on the same files and gives rows to compare."""

import math
import os

import duckdb
import pandas as pd


def plain(v):
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return int(v) if abs(v) < 1e15 and v == int(v) else float(f"{v:.8g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False))


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con
