"""Runs a query on Spark and its SQL on DuckDB over the same tables."""

import glob
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, names, data):
    at = [names.index(c) for c in columns]
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in data)


def assert_same(df, sql):
    columns = sorted(df.columns)
    got = rows_of(columns, df.columns, df.collect())
    result = connect().execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = rows_of(columns, names, result.fetchall())
    assert got == want
    return len(got)
