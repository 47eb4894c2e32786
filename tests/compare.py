"""Compares a query with its SQL on DuckDB, rows in any order."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def canonical(frame):
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return round(v, 6) if v != int(v) else int(v)
        return v

    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(value(v) for v in row)) for row in frame[columns].itertuples(index=False))


def assert_same(df, db, sql):
    mine, theirs = canonical(df.toPandas()), canonical(db.sql(sql).df())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
