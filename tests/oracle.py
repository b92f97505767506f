"""Spark's rows against DuckDB's, as multisets."""

import glob
import math

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(sf_dir=SMALL):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(c, sql):
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
