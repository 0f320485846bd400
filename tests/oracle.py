"""Side-by-side comparison of a query with its SQL in DuckDB."""

import datetime
from glob import glob
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connect():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return f"{v + 0.0:.5f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(con, sql, columns):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    return sorted(tuple(_norm(r[names.index(c)]) for c in columns) for r in result.fetchall())
