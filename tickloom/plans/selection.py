"""Choosing rows to learn from: trust region, tail weights, sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import drop_incomplete
from tickloom.operators.metrics import with_mahalanobis
from tickloom.operators.moments import co_moments
from tickloom.operators.positions import sorted_positions
from tickloom.operators.quantiles import grouped_quantiles
from tickloom.operators.sampling import sample_rows
from tickloom.session import cut_lineage

TRUST_QUANTILE = 0.99


def trust_region(df: DataFrame, columns: Sequence[str], quantile: float = TRUST_QUANTILE) -> DataFrame:
    """Add ``distance`` and ``on_manifold``; rows outside the region are flagged, not dropped.

    Only the mean vector and the covariance matrix reach the driver.
    """
    # The features are read for the covariance, for the radius and for the result.
    known = cut_lineage(drop_incomplete(df, list(columns)))
    moments = co_moments(known, columns)
    # Staged: the distances are read for the radius and for the result.
    measured = cut_lineage(with_mahalanobis(known, columns, moments.mean, moments.sample_cov))
    radius = grouped_quantiles(measured, [], "distance", {"radius": quantile}).select("radius").scalar()
    return measured.withColumn("on_manifold", F.col("distance") <= radius)


def tail_weights(df: DataFrame, distance: str, tie: Sequence[str]) -> DataFrame:
    """Add ``weight`` from 1 for the nearest row to 5 for the farthest, linear in the rank."""
    placed = sorted_positions(df, [], [F.col(distance), *[F.col(t) for t in tie]], "_place")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    span = F.greatest(F.col("_n") - 1, F.lit(1))
    return (
        placed.withColumn("_n", total)
        .withColumn("weight", 1.0 + 4.0 * (F.col("_place") - 1) / span)
        .drop("_place", "_n")
    )


def renormalise(df: DataFrame, weight: str) -> DataFrame:
    """Scale weights so that they sum to the number of rows."""
    df = cut_lineage(df)
    totals = df.agg(F.sum(weight).alias("s"), F.count(F.lit(1)).alias("n")).select(F.struct("s", "n")).scalar()
    return (
        df.withColumn("_t", totals)
        .withColumn(weight, F.col(weight) / F.col("_t.s") * F.col("_t.n"))
        .drop("_t")
    )


def select_rows(
    df: DataFrame, columns: Sequence[str], ident: Sequence[str], n: int, seed: int | str
) -> DataFrame:
    """Trust region and tail weights over all usable rows, then a seeded sample of ``n``."""
    weighted = tail_weights(trust_region(df, columns), "distance", ident)
    return renormalise(sample_rows(weighted, ident, n, seed), "weight")
