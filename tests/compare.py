"""Side-by-side run of a query and its SQL."""

import glob
import math
import os

import duckdb


def views(path):
    c = duckdb.connect()
    for f in glob.glob(f"{path}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    r = con.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    return cols, sorted((tuple(_plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
