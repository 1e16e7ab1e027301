"""Compare a Spark result with DuckDB on the same tables."""

import math

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.astype(object).itertuples(index=False))


def same(spark, query, sql, sf=SF):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = query(spark, sf).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
