"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut_lineage


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest node around ``u``: the larger ones, or the smaller ones and ``u``."""
    around = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    lowest = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = around.join(lowest, "u")
    if large:
        moved = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lowest.select("u", F.col("m").alias("v"))
        )
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for each node of a link that joins two nodes.

    Each round replaces links by links to smaller nodes and halves path lengths, roughly; it ends when the
    links are stars. Links live in tables of the shared folder, only their count reaches the driver.
    """
    pairs = cut_lineage(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter(F.col("u") != F.col("v")).distinct()
    )
    seen = None
    for _ in range(max_rounds):
        pairs = cut_lineage(_stars(_stars(pairs, True), False))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
    raise RuntimeError("link contraction did not settle")
