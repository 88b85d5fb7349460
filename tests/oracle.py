"""Runs a query and its SQL twin over one data folder and compares names and values."""

import glob
import os
from functools import lru_cache

import duckdb

DATA = "/root/testdata/sf0.001"


@lru_cache(1)
def connection():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: str(v.tolist()) if hasattr(v, "tolist") else str(v)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))


def compare(spark, query, sql):
    got = query(spark, DATA).toArrow().to_pandas()
    want = connection().execute(sql).fetch_df()
    assert rows(got) == rows(want)
