"""Run a registered query on Spark and its SQL twin on DuckDB; compare.

Mirrors the driver's check: same column names, same row count, equal
values after sorting columns by name and rows by value.
"""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from trawl.sources.tables import DRIVER_TABLES, table_path


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm_value(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm_value(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, bytes | bytearray):
        return bytes(v)
    return v


def _rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm_value(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark_df, con, sql: str):
    s_cols, s_rows = _rows(spark_df.toPandas())
    d_cols, d_rows = _rows(con.sql(sql).df())
    problems = []
    if s_cols != d_cols:
        problems.append(f"columns differ: spark={s_cols} duck={d_cols}")
    if len(s_rows) != len(d_rows):
        problems.append(f"row count differs: spark={len(s_rows)} duck={len(d_rows)}")
    if not problems and s_rows != d_rows:
        diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
        problems.append(f"values differ, first: {diff}")
    return problems, len(s_rows)
