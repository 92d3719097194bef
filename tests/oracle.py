"""Compares a query with its SQL as run by DuckDB over the same tables."""

import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        p = os.path.join(sf, f)
        src = p + "/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {f[: -len('.parquet')]} as select * from '{src}'")
    return con


def rows_of_sql(con, sql):
    rel = con.sql(sql)
    names = list(rel.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rel.limit(10**9).fetchall()), key=repr)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
