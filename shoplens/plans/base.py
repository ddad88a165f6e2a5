"""Registry plumbing shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: QueryFn
    sql: str | None  # None -> rows-only check (non-SQL-expressible)


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def r6(c) -> Column:
    """Round a double output column to 6 places (same in the oracle: ROUND(x, 6))."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6)


def ts_text(c) -> Column:
    """Timestamps leave queries as text; oracle: strftime(x, '%Y-%m-%d %H:%M:%S')."""
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def vec_text(c) -> Column:
    """A whole vector as text, in millionths; oracle: :func:`vec_text_sql`. Null stays null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(col, lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")


def vec_text_sql(x: str) -> str:
    return f"list_aggregate(list_transform({x}, lambda u: CAST(CAST(round(u * 1000000) AS BIGINT) AS VARCHAR)), 'string_agg', ',')"
