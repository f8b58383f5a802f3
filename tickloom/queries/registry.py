"""Registry of named queries and small helpers shared by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(column: Column | str, name: str | None = None, digits: int = 6) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    out = F.round(col.cast("double"), digits)
    label = name or (column if isinstance(column, str) else None)
    return out.alias(label) if label else out


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, for comparison across engines."""
    return df.select(
        *[r6(n, digits=digits) if t == "double" else F.col(n) for n, t in df.dtypes]
    )


def draw_sql(seed: int | str, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'", *keys])
    return f"CAST(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::UBIGINT AS BIGINT)"
