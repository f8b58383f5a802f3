"""Symbol statistics and stratification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import ratio
from tickloom.operators.filters import keep_groups, strictly_valid_quote, valid_quote
from tickloom.operators.frames import CHUNK_ROWS, over_rows
from tickloom.operators.positions import sorted_positions, tile
from tickloom.operators.quantiles import grouped_medians, grouped_quantiles
from tickloom.session import cut_lineage

MIN_QUOTES = 200
MOVE_LAG = 20
MIN_TICK_SHARE = 0.5


def liquidity_stats(
    quotes: DataFrame,
    keys: Sequence[str],
    seq: str,
    *,
    min_quotes: int = MIN_QUOTES,
    move_lag: int = MOVE_LAG,
    resequence=None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per symbol: quote count and medians of spread, best ask size and absolute move.

    Expects ``bid1, ask1, ask1_qty``. The move looks ``move_lag`` valid quotes back, so
    ``resequence`` (a function that recomputes ``seq``) is needed where invalid quotes exist.
    """
    enough = keep_groups(quotes, keys, min_quotes)
    valid = enough.filter(valid_quote(F.col("bid1"), F.col("ask1")))
    if resequence is not None:
        valid = resequence(valid)

    def build(df: DataFrame, w) -> DataFrame:
        mid = (F.col("bid1") + F.col("ask1")) / 2.0
        staged = df.withColumn("_mid", mid)
        return staged.withColumns(
            {
                "spread_bps": (F.col("ask1") - F.col("bid1")) / F.col("_mid") * 1e4,
                "rv_bps": F.abs(F.col("_mid") / F.lag("_mid", move_lag).over(w) - 1.0) * 1e4,
            }
        )

    moved = over_rows(
        valid.select(*keys, seq, "bid1", "ask1", "ask1_qty"), keys, seq, build,
        before=move_lag, chunk_rows=chunk_rows,
    )
    # Three narrow columns, written once and read by the counts and both quantile passes.
    moved = cut_lineage(moved.select(*keys, "spread_bps", "ask1_qty", "rv_bps"))
    counts = moved.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_quote")).filter(
        F.col("n_quote") >= min_quotes
    )
    medians = grouped_medians(moved, keys, ["spread_bps", "ask1_qty", "rv_bps"])
    return counts.join(medians, list(keys)).select(
        *keys,
        "n_quote",
        "spread_bps",
        F.col("ask1_qty").alias("ask1_depth"),
        F.coalesce("rv_bps", F.lit(0.0)).alias("rv_bps"),
    )


def friction_layers(stats: DataFrame) -> DataFrame:
    """Add ``friction``: L up to the first spread tertile, M up to the second, then H.

    The statistics have one row per symbol and are read several times, so they are cut off
    from the tick job that made them.
    """
    stats = cut_lineage(stats)
    cuts = grouped_quantiles(stats, [], "spread_bps", {"low": 1 / 3, "high": 2 / 3})
    spread = F.col("spread_bps")
    return (
        stats.withColumn("_c", cuts.select(F.struct("low", "high")).scalar())
        .withColumn(
            "friction",
            F.when(spread <= F.col("_c.low"), "L").when(spread <= F.col("_c.high"), "M").otherwise("H"),
        )
        .drop("_c")
    )


def assign_strata(stats: DataFrame) -> DataFrame:
    """Add ``friction``, ``depth`` (median split inside each friction layer) and ``stratum``."""
    layered = cut_lineage(friction_layers(stats))
    medians = grouped_quantiles(layered, ["friction"], "ask1_depth", {"_median": 0.5})
    return (
        layered.join(medians, "friction")
        .withColumn("depth", F.when(F.col("ask1_depth") <= F.col("_median"), "shallow").otherwise("deep"))
        .withColumn("stratum", F.concat_ws("-", "friction", "depth"))
        .drop("_median")
    )


def symbol_covariates(
    quotes: DataFrame, key: str, *, levels: int = 5, min_quotes: int = 50, turnover: str = "turnover"
) -> DataFrame:
    """Tick size (commonest gap between neighbouring levels), relative tick, spread in ticks.

    Expects ``bid1, ask1`` and the price arrays. Equal counts take the smaller gap. A symbol with quotes
    but without a gap stays, with ``ok`` false and no tick.
    """
    valid = keep_groups(
        quotes.filter(strictly_valid_quote(F.col("bid1"), F.col("ask1"))), [key], min_quotes
    )
    pairs = []
    for side in ("ask_px", "bid_px"):
        for i in range(1, levels):
            a, b = F.element_at(side, i), F.element_at(side, i + 1)
            pairs.append(F.when((a > 0) & (b > 0), F.abs(b - a)))
    gaps = (
        valid.select(key, F.explode(F.array(*pairs)).alias("gap"))
        .filter(F.col("gap") > 0)
        .groupBy(key, "gap")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ticks = gaps.groupBy(key).agg(
        F.max(F.struct("n", (-F.col("gap")).alias("minus")))
        .alias("top"),
        F.sum("n").alias("total"),
    ).select(
        key,
        (-F.col("top.minus")).alias("tick"),
        ratio(F.col("top.n"), F.col("total")).alias("tick_share"),
    )
    spread = F.col("ask1") - F.col("bid1")
    shape = valid.join(ticks, key, "left").groupBy(key).agg(
        F.avg(spread / F.col("tick")).alias("mean_spread_ticks"),
        F.avg((spread == F.col("tick")).cast("double")).alias("frac_one_tick"),
        F.count(F.lit(1)).alias("n_quotes"),
    )
    mids = grouped_quantiles(
        valid.withColumn("_mid", (F.col("bid1") + F.col("ask1")) / 2), [key], "_mid", {"median_price": 0.5}
    )
    traded = quotes.groupBy(key).agg(F.max(turnover).alias("traded_value"))
    return (
        shape.join(ticks, key, "left")
        .join(mids, key)
        .join(traded, key)
        .withColumn("rel_tick_bps", ratio(F.col("tick") * 1e4, F.col("median_price")))
        .withColumn("ok", F.col("tick").isNotNull())
    )


def tick_size_known(covariates: DataFrame, min_share: float = MIN_TICK_SHARE) -> DataFrame:
    """Symbols whose commonest gap is common enough to be the tick size."""
    return covariates.filter(F.col("tick_share") >= min_share)


def tertile_groups(covariates: DataFrame, key: str) -> DataFrame:
    """Thirds by mean spread in ticks (ties: more one-tick quotes first) and by turnover."""
    covariates = cut_lineage(covariates.filter(F.col("mean_spread_ticks").isNotNull()))
    total = covariates.agg(F.count(F.lit(1)).alias("n")).scalar()
    by_tick = sorted_positions(
        covariates.select(key, "mean_spread_ticks", "frac_one_tick", "traded_value"),
        [],
        [F.col("mean_spread_ticks"), -F.col("frac_one_tick"), F.col(key)],
        "_tick_place",
    )
    by_both = sorted_positions(by_tick, [], [F.col("traded_value"), F.col(key)], "_liq_place")
    return by_both.withColumn("_n", total).select(
        key,
        tile(F.col("_tick_place"), F.col("_n"), 3).alias("tick_group"),
        tile(F.col("_liq_place"), F.col("_n"), 3).alias("liq_group"),
    )
