"""Comparison of a query with its SQL in DuckDB."""

import glob
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return norm(float(v))
    return v


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def spark_rows(df):
    names = sorted(df.columns)
    return sorted(repr(tuple(norm(r[c]) for c in names)) for r in df.collect())


def duck_rows(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr(tuple(norm(r[i]) for i in order)) for r in got.fetchall())
