"""Named queries over the given tables, and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rnd(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(c, digits) for c in cols})


def text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd")


def big(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long")


def R(expr: str, digits: int = 6) -> str:
    return f"(ROUND(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def sel(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in cols.items())


def chain(*parts: str, recursive: bool = False) -> str:
    """CTEs then the final SELECT."""
    *ctes, body = parts
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
