"""Compare registered queries with their SQL twins: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        return value.date()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> list:
    """Empty when equal; otherwise what differs, first rows only."""
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(df.columns), sorted(names))]
    got, want = rows_of(df.columns, df.collect()), rows_of(names, answer.fetchall())
    if len(got) != len(want):
        return [("rows", len(got), len(want))]
    return [("row", a, b) for a, b in zip(got, want) if a != b][:3]
