"""Rows of a Spark query against rows of its SQL in DuckDB, by sorted representation."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def sql_rows(sql, sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = db.sql(sql)
    names = sorted(r.columns)
    at = [r.columns.index(c) for c in names]
    return names, sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


def assert_same(df, sql, sf_dir):
    a, b = spark_rows(df), sql_rows(sql, sf_dir)
    assert a[0] == b[0]
    assert a[1] == b[1]
