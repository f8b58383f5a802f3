"""Economics and agreement of threshold signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import ratio
from tickloom.operators.quantiles import grouped_quantiles


def signal_statistics(
    df: DataFrame, by: Sequence[str], y: str, signals: Mapping[tuple[str, str], tuple[Column, str]]
) -> DataFrame:
    """Per model, rule and ``by`` key: signal rows, outcome sum, positive outcomes, score sum.

    ``signals`` maps ``(model, rule)`` to the signal and the model's score column. Rows go to long
    form only for the signals that fire.
    """
    fired = F.array_compact(
        F.array(
            *[
                F.when(
                    signal,
                    F.struct(F.lit(m).alias("model"), F.lit(r).alias("rule"), F.col(score).alias("score")),
                )
                for (m, r), (signal, score) in signals.items()
            ]
        )
    )
    out = F.col(y)
    return (
        df.select(*by, y, F.inline(fired))
        .groupBy("model", "rule", *by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(out).alias("sy"),
            F.count_if(out > 0).alias("npos"),
            F.sum("score").alias("sp"),
        )
    )


def signal_economics(stats: DataFrame, by: Sequence[str], total_rule: str = "all") -> DataFrame:
    """Totals of :func:`signal_statistics` with shares of the ``total_rule`` rows."""
    sums = stats.groupBy("model", "rule", *by).agg(
        F.sum("n").alias("n_rows"),
        F.countDistinct("symbol").alias("n_symbols"),
        *[F.sum(c).alias(c) for c in ("sy", "npos", "sp")],
    )
    totals = sums.filter(F.col("rule") == total_rule).select("model", *by, F.col("n_rows").alias("_total"))
    return sums.join(totals, ["model", *by]).select(
        "model",
        "rule",
        *by,
        "n_rows",
        "n_symbols",
        ratio(F.col("n_rows"), F.col("_total")).alias("share_of_rows"),
        ratio(F.col("sy"), F.col("n_rows")).alias("mean_y"),
        ratio(F.col("npos"), F.col("n_rows")).alias("pos_share"),
        ratio(F.col("sp"), F.col("n_rows")).alias("mean_pred"),
    )


def agreement_rates(
    df: DataFrame, fresh: Mapping[str, str], stored: Mapping[str, str], rules: Mapping[str, float]
) -> DataFrame:
    """Share of rows on which the signals of a fresh and a stored score agree, for every pair of
    models and every rule (a fixed threshold)."""
    cells = []
    for f, fcol in fresh.items():
        for s, scol in stored.items():
            for rule, cut in rules.items():
                same = (F.col(fcol) > cut) == (F.col(scol) > cut)
                cells.append((f, s, rule, F.avg(same.cast("double"))))
    wide = df.agg(*[c.alias(f"a{i}") for i, (*_, c) in enumerate(cells)])
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("fresh"), F.lit(s).alias("stored"), F.lit(r).alias("rule"),
                F.col(f"a{i}").alias("rate"),
            )
            for i, (f, s, r, _) in enumerate(cells)
        ]
    )
    return wide.select(F.inline(rows))


def difference_distribution(df: DataFrame, left: str, right: str, tolerance: float = 1e-5) -> DataFrame:
    """Largest, upper-tail and middle absolute differences and the share above ``tolerance``."""
    diffs = df.select(F.abs(F.col(left) - F.col(right)).alias("_d"))
    cuts = grouped_quantiles(diffs, [], "_d", {"q999": 0.999, "q99": 0.99, "median": 0.5})
    shape = diffs.agg(
        F.max("_d").alias("max"),
        F.avg((F.col("_d") > tolerance).cast("double")).alias("share_above"),
        F.count("_d").alias("n"),
    )
    return shape.withColumn("_q", cuts.select(F.struct("*")).scalar()).select("*", "_q.*").drop("_q")
