"""Top-n, unions and set checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group. Spark limits each group before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def union_blocks(blocks: Mapping[str, DataFrame], ident: str) -> DataFrame:
    """Stack blocks by column name, each row carrying the id of its block."""
    parts = [df.withColumn(ident, F.lit(name)) for name, df in blocks.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def assert_disjoint(sets: Mapping[str, DataFrame], key: str) -> None:
    """Raise when a key belongs to more than one set. One aggregate over all sets."""
    tagged = union_blocks({n: d.select(key).distinct() for n, d in sets.items()}, "_set")
    shared = tagged.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).limit(5)
    rows = shared.collect()
    if rows:
        raise ValueError(f"sets overlap, e.g. {[r[key] for r in rows]}")


def shared_members(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Per set (``part``) its members, and how many of them are in another set too."""
    tagged = union_blocks({n: d.select(key).distinct() for n, d in sets.items()}, "part")
    held = tagged.groupBy(key).agg(F.collect_set("part").alias("_parts"))
    each = held.select(F.explode("_parts").alias("part"), (F.size("_parts") > 1).alias("_shared"))
    return each.groupBy("part").agg(F.count(F.lit(1)).alias("members"), F.count_if("_shared").alias("shared"))


def missing_pairs(requested: DataFrame, loaded: DataFrame, on: Sequence[str]) -> DataFrame:
    return requested.select(*on).distinct().join(loaded.select(*on), list(on), "left_anti")


def common_members(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)
