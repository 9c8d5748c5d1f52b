"""Spark results against DuckDB's over the same Parquet files."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        x = float(v)
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def spark_rows(df, columns):
    return sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)


def duck_rows(con, sql, columns):
    names = ", ".join(f'"{c}"' for c in columns)
    return sorted((tuple(plain(x) for x in r) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall()), key=repr)
