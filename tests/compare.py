"""Rows of Spark against rows of DuckDB, whatever their order."""

import math
import os

import duckdb
import pandas as pd


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return str(v) if isinstance(v, pd.Timestamp) else v


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def assert_same(df, con, sql):
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    theirs = r.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    a = sorted((tuple(plain(x[n]) for n in order) for x in df.collect()), key=repr)
    b = sorted((tuple(plain(x[names.index(n)]) for n in order) for x in theirs), key=repr)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    assert not wrong, wrong[:3]
