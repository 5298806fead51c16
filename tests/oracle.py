"""Side-by-side runs of a query and its DuckDB equivalent."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if hasattr(x, "tzinfo") and x.tzinfo is not None:
        x = x.replace(tzinfo=None)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return x


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in data), key=repr)


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    left = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    right = rows(names, found.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"{name}: columns {sorted(df.columns)} and {sorted(names)}")
    if len(left) != len(right):
        out.append(f"{name}: {len(left)} and {len(right)} rows")
    bad = [(a, b) for a, b in zip(left, right, strict=False) if a != b]
    if bad:
        out.append(f"{name}: {len(bad)} rows differ, first {bad[0]}")
    return out
