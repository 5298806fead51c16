"""The table of queries: a callable and, where SQL can say it, the same query for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own or another name."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return put


def rounded(x: Column | str, digits: int = 4, shift: float = 1e-7) -> Column:
    """For comparing doubles of two engines: rounded after a shift that moves exact halves off the edge."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + F.lit(shift), digits) + F.lit(0.0)


def rounded_sql(x: str, digits: int = 4, shift: float = 1e-7) -> str:
    return f"(round(({x}) + {shift!r}::DOUBLE, {digits}) + 0.0)"
