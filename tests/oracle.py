"""Compares a query with its SQL on the same tables."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return c


def _cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(x) for x in r) for r in df[names].astype(object).itertuples(index=False))


def compare(spark, connection, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toPandas(), connection.execute(sql).fetch_df()
    # whole numbers with nulls come as floats from one side only
    for c in want.columns:
        if c in got.columns and str(want[c].dtype) == "Int64":
            got[c] = got[c].astype("Int64")
    assert rows(got) == rows(want)
