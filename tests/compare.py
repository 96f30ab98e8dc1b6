"""Rows of a Spark query against rows of its DuckDB SQL, whatever their order."""

import datetime
import glob
import math
import os

import duckdb
import pandas as pd


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}")
    if isinstance(v, datetime.date):
        return str(v)[:10]
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(str(_value(v)) for v in r) for r in df.itertuples(index=False))


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same(spark, sf_dir, query, sql):
    mine, theirs = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
