"""Comparison of a query's rows with its DuckDB SQL on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_sql(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
