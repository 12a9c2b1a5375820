"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import numpy as np
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connection(folder: str = DATA):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(frame, columns):
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "null"
        return str(float(v)) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def same(spark_frame, sql: str, con) -> None:
    mine, theirs = spark_frame.toPandas(), con.sql(sql).df()
    columns = sorted(theirs.columns)
    assert columns == sorted(mine.columns)
    assert plain(mine, columns) == plain(theirs, columns)
