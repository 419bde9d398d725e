"""Spark results against DuckDB's on the same files."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, Decimal):
            v = float(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6) + 0.0
        if isinstance(v, bool) or v is None:
            return v
        return v if isinstance(v, int) else str(v)

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, f, sql: str, sf_dir: str) -> str:
    """Empty if both agree."""
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    b = rows(names, want.fetchall())
    df = f(spark, sf_dir)
    a = rows(df.columns, df.collect())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if a != b:
        return f"{len(a)} and {len(b)} rows; first that differ: {next(((x, y) for x, y in zip(a, b) if x != y), None)}"
    return ""
