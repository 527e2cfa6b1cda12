"""Compares a query's rows with those of its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "N"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def connect(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def assert_equal(df, con, sql):
    names = sorted(df.columns)
    got = sorted("|".join(norm(r[c]) for c in names) for r in df.collect())
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    assert got == sorted("|".join(norm(r[i]) for i in at) for r in rel.fetchall())
