"""Results compared as bags of rows, numbers to nine digits."""

import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def views(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW \"{os.path.basename(path)[:-8]}\" AS SELECT * FROM '{files}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("T", " ").replace(" 00:00:00", "")
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def spark_bag(df):
    return bag(df.columns, [tuple(r) for r in df.collect()])


def sql_bag(con, sql):
    r = con.execute(sql)
    return bag([d[0] for d in r.description], r.fetchall())
