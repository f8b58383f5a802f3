"""Lookups, alignment checks and parameter tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 1_000


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on), list(on), "left_semi")


def lookup(facts: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of attributes. No hint: the planner broadcasts the dimension only when its
    measured size allows and splits skewed partitions otherwise."""
    return facts.join(dimension, list(on), "left")


def attach_scores(
    ticks: DataFrame, scores: DataFrame, on: Sequence[str], verify: Sequence[str], score: str
) -> DataFrame:
    """Join scores on the row key and flag rows whose ``verify`` columns disagree or are absent."""
    right = scores.select(*on, score, *[F.col(v).alias(f"_v_{v}") for v in verify])
    joined = ticks.join(right, list(on), "left")
    agree = F.col(score).isNotNull()
    for v in verify:
        agree = agree & F.col(v).eqNullSafe(F.col(f"_v_{v}"))
    return joined.withColumn("mismatch", ~agree).drop(*[f"_v_{v}" for v in verify])


def alignment(
    left: DataFrame, right: DataFrame, on: Sequence[str], outcome: str
) -> DataFrame:
    """Full outer pairing of two prediction tables with a ``mismatch`` flag per row."""
    a = left.select(*on, F.lit(True).alias("_a"), F.col(outcome).alias("_ya"))
    b = right.select(*on, F.lit(True).alias("_b"), F.col(outcome).alias("_yb"))
    paired = a.join(b, list(on), "full_outer")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("_ya").eqNullSafe(F.col("_yb"))
    return paired.withColumn("mismatch", ~same).drop("_a", "_b")


def pair_predictions(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    outcome: str,
    pred_left: str,
    pred_right: str,
    check: bool = True,
) -> DataFrame:
    """Rows of both tables side by side; refuses tables whose rows or outcomes differ."""
    if check:
        bad = alignment(left, right, on, outcome).agg(F.count_if("mismatch").alias("n")).first()["n"]
        if bad:
            raise ValueError(f"the two prediction tables disagree on {bad} rows")
    a = left.select(*on, outcome, F.col(pred_left).alias("pred_left"))
    b = right.select(*on, F.col(pred_right).alias("pred_right"))
    return a.join(b, list(on))


def parameter_rows(contracts: DataFrame, grid: Sequence[float], theta: str = "theta") -> DataFrame:
    """``contract_id, graded_id, theta, q``: each contract at each grid quantile, to be looked up by contract."""
    quantiles = F.explode(F.array(*[F.lit(float(q)) for q in grid]))
    return contracts.select("contract_id").distinct().select("contract_id", quantiles.alias("q")).select(
        "contract_id", F.format_string("%s:q%.2f", F.col("contract_id"), F.col("q")).alias("graded_id"), F.lit(theta).alias("theta"), "q"
    )


def parameter_table(
    symbols: DataFrame, symbol: str, contracts: DataFrame, grid: Sequence[float], theta: str = "theta"
) -> DataFrame:
    """:func:`parameter_rows` for every symbol, as rows.

    The result is all of contracts, quantiles and symbols. Contracts are data of any number: they are packed into blocks,
    each symbol is dealt to every block by an equality join, and a block is unpacked beside it. Where the rows
    only have to be found for given decisions, join ``parameter_rows`` by contract instead.
    """
    rows = parameter_rows(contracts, grid, theta)
    blocks = max(1, -(-rows.count() // ROWS_PER_BLOCK))
    packed = rows.groupBy(F.pmod(F.xxhash64("contract_id"), F.lit(blocks)).cast("int").alias("_block")).agg(
        F.collect_list(F.struct("contract_id", "graded_id", "theta", "q")).alias("_entries")
    )
    dealt = symbols.select(symbol, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    return dealt.join(packed, "_block").select(symbol, F.inline("_entries")).select("contract_id", "graded_id", symbol, "theta", "q")


def colliding_ids(contracts: DataFrame, base: Column, q: Column) -> DataFrame:
    """Graded ids (two decimals) that more than one quantile of a contract would share."""
    graded = contracts.select(F.format_string("%s:q%.2f", base, q).alias("graded_id"), q.alias("_q"))
    return graded.groupBy("graded_id").agg(F.countDistinct("_q").alias("n")).filter(F.col("n") > 1)


def overlap_counts(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """How many keys are in both sets, only in the first, only in the second."""
    a = left.select(on).distinct().withColumn("_a", F.lit(True))
    b = right.select(on).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, on, "full_outer")
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both"),
        F.count_if(F.col("_b").isNull()).alias("missing"),
        F.count_if(F.col("_a").isNull()).alias("new"),
    )
