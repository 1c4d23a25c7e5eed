"""Compares each query with its SQL twin in DuckDB: columns, number of rows, order-free values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 5) + 0.0
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    """None if both agree, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    ours = rows(spark_df.columns, spark_df.collect())
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows; only ours {[x for x in ours[:2000] if x not in theirs][:3]}; only theirs {[x for x in theirs[:2000] if x not in ours][:3]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} rows differ, as {bad[:3]}" if bad else None
