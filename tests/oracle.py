"""Runs a query and its SQL on the same tables and compares rows."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "None" if pd.isna(v) else f"{v:.9g}"
    if v is None or v is pd.NaT or v is pd.NA:
        return "None"
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    frame = frame[columns]
    for c in columns:  # whole numbers that pandas holds as floats because of nulls
        if str(frame[c].dtype) in ("Int32", "Int64"):
            frame = frame.assign(**{c: frame[c].astype(float)})
    return columns, sorted(tuple(_value(v) for v in r) for r in frame.itertuples(index=False))


def compare(spark, sf, run, sql):
    got, want = rows(run(spark, sf).toPandas()), rows(connect(sf).execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
