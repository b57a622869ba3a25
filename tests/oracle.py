"""Compares a query with its SQL, as sorted rows by column name."""

import glob
import math
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return db


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(_cell(v) for v in r) for r in frame.astype(object).itertuples(index=False))


def same(spark, query, sql):
    got, want = rows(query(spark, DATA).toPandas()), rows(connect().execute(sql).df())
    assert got[0] == want[0]
    # floats with no fraction come as such where the other side has nulls
    strip = lambda rs: [tuple(c.removesuffix(".0") for c in r) for r in rs]
    assert strip(got[1]) == strip(want[1])
