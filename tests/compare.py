"""Runs registered queries beside their DuckDB statements, as the driver does."""

import glob
import os

import duckdb
import pandas as pd


def connected(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def table(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NA or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v))
    return sorted(map(tuple, df.itertuples(index=False)))


def difference(spark, con, sf_dir, query, sql):
    """None, or what differs."""
    ours, theirs = query(spark, sf_dir), con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a = table(pd.DataFrame([r.asDict() for r in ours.collect()], columns=ours.columns))
    b = table(theirs)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return None if not bad else f"{len(bad)} rows differ, the first: {bad[0]}"
