"""A query's rows beside those of its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(x):
    if hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return tuple(x.tolist())
    if isinstance(x, list):
        return tuple(x)
    if isinstance(x, (str, bytes, dict, bool)) or x is None:
        return x
    if pd.isna(x):
        return None
    return round(x, 6) if isinstance(x, float) else x


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


def assert_same(spark, query, sql, sf_dir):
    want_cols, want = rows(connect(sf_dir).execute(sql).fetchdf())
    cols, got = rows(query(spark, sf_dir).toPandas())
    assert cols == want_cols
    assert [repr(r) for r in got] == [repr(r) for r in want]
