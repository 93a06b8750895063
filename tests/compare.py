"""Rows of a query against rows of its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return repr(v)


def sql_rows(sql, sf_dir, columns):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return sorted(tuple(cell(row[i]) for i in at) for row in got.fetchall())


def spark_rows(df, columns):
    return sorted(tuple(map(cell, row)) for row in df.select(*columns).collect())


def same(df, sql, sf_dir):
    columns = sorted(df.columns)
    ours, theirs = spark_rows(df, columns), sql_rows(sql, sf_dir, columns)
    assert len(ours) == len(theirs)
    assert ours == theirs
