"""Row filters and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import clip
from tickloom.operators.quantiles import grouped_quantiles


def valid_quote(bid: Column, ask: Column) -> Column:
    return (bid > 0) & (ask > 0) & (ask >= bid)


def strictly_valid_quote(bid: Column, ask: Column) -> Column:
    return (bid > 0) & (ask > bid)


def keep_groups(df: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Rows of groups with at least ``min_rows`` rows; counts are aggregated, not windowed."""
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    return df.join(large.select(*keys), list(keys), "left_semi")


def winsorise(df: DataFrame, keys: Sequence[str], value: str, upper: float) -> DataFrame:
    """Cap ``value`` at its ``upper`` quantile within each key."""
    caps = grouped_quantiles(df, keys, value, {"_cap": upper})
    joined = df.join(caps, list(keys), "left") if keys else df.withColumn(
        "_cap", caps.select("_cap").scalar()
    )
    over = F.col(value) > F.col("_cap")
    return joined.withColumn(value, F.when(over, F.col("_cap")).otherwise(F.col(value))).drop("_cap")


def clip_to_domain(df: DataFrame, columns: Sequence[str], domain: DataFrame) -> DataFrame:
    """Clamp inputs to the range seen in fitting; ``domain`` is one row of ``lo_<c>, hi_<c>``."""
    bounds = df.withColumn("_d", domain.select(F.struct("*")).scalar())
    return bounds.withColumns(
        {c: clip(F.col(c), F.col(f"_d.lo_{c}"), F.col(f"_d.hi_{c}")) for c in columns}
    ).drop("_d")


def domain_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
    )


def columns_seen_everywhere(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Columns with at least one value in every group; a symbol without trades loses its trade
    features, and only the common ones can be stacked. Reads one aggregated row."""
    seen = df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in columns])
    lowest = seen.agg(*[F.min(c).alias(c) for c in columns]).first()
    return [c for c in columns if (lowest[c] or 0) > 0]


def common_columns(frames: Sequence[DataFrame]) -> list[str]:
    shared = set.intersection(*[set(f.columns) for f in frames])
    return [c for c in frames[0].columns if c in shared]


def with_units(df: DataFrame, units: Mapping[str, str]) -> DataFrame:
    """Record each column's dimension in its metadata."""
    return df.select(
        *[
            F.col(c).alias(c, metadata={"dimension": units[c]}) if c in units else F.col(c)
            for c in df.columns
        ]
    )


def dimensionless(df: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """Keys plus dimensionless columns, and why each other column was dropped."""
    kept, dropped = list(keep), {}
    for field in df.schema.fields:
        if field.name in keep:
            continue
        unit = (field.metadata or {}).get("dimension")
        if unit == "dimensionless":
            kept.append(field.name)
        else:
            dropped[field.name] = f"dimension {unit}" if unit else "no dimension recorded"
    return df.select(*kept), dropped
