"""Rows of a Spark query against those of its SQL in DuckDB, in any order, columns by name."""

from __future__ import annotations

import datetime as dt
import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int | float | decimal.Decimal):
        return None if x != x else round(float(x), 6) + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, dict):
        return tuple(plain(v) for _, v in sorted(x.items()))
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    return x


def in_order(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def both(spark, con, run, sql: str, sf_dir: str):
    df = run(spark, sf_dir)
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns), (df.columns, found.columns)
    return in_order(df.columns, [tuple(r) for r in df.collect()]), in_order(found.columns, found.fetchall())
