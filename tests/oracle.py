"""Comparison of a query with its SQL, by values, whatever their order."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


def compare(con, sql, df):
    q = con.sql(sql)
    assert set(q.columns) == set(df.columns)
    columns = sorted(q.columns)
    want = sorted(tuple(text(r[q.columns.index(c)]) for c in columns) for r in q.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in df.collect()) == want
