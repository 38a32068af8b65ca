"""Run queries in Spark and their oracle SQL in DuckDB over one folder of tables, and compare."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    return x


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def difference(spark, folder: str, query, sql: str, con=None) -> str | None:
    """None if both agree, else what differs."""
    df = query(spark, folder)
    mine = rows(df.columns, df.collect())
    found = (con or connect(folder)).execute(sql)
    names = [c[0] for c in found.description]
    theirs = rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    off = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(off)} of {len(mine)} rows, such as {off[0]}" if off else None
