"""Forward labels: net return after a fixed horizon, and whether a resting order would fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.book import FEE_BPS
from tickloom.functions.numeric import positive, ratio
from tickloom.operators.asof import fill_flag, forward_asof

HORIZON_US = 30_000_000
ORDER_TICKS = 100
ORDER_US = 10_000_000


def path_label(
    ticks: DataFrame,
    keys: Sequence[str],
    time: str,
    seq: str,
    *,
    horizon_us: int = HORIZON_US,
    bucket_us: int | None = None,
    fee_bps: float = FEE_BPS,
    keep: Sequence[str] = (),
    previous: str | None = None,
) -> DataFrame:
    """``raw_net_bps``, ``y_path`` and ``mask`` from the first tick at or after the horizon.

    Expects ``bid1`` and ``ask1``. A horizon past the day end is unobserved. The result has the
    row key, the two prices, ``keep`` and the labels; wide book columns would travel through the
    shuffle for nothing.
    """
    exits = forward_asof(
        ticks,
        keys,
        time,
        seq,
        horizon_us=horizon_us,
        take={"_exit_seq": seq, "_exit_bid": "bid1"},
        bucket_us=bucket_us or 2 * horizon_us,
        keep=[seq, time, "bid1", "ask1", *keep],
        previous=previous,
    )
    bid, ask = F.col("bid1"), F.col("ask1")
    sold, bought = positive(F.col("_exit_bid")), positive(ask)
    raw = (ratio(sold, bought) - 1.0) * 1e4 - fee_bps
    spread = ratio((ask - bid) * 1e4, (bid + ask) / 2.0)
    labelled = exits.withColumn("raw_net_bps", F.when(F.col("_exit_seq").isNotNull(), raw))
    return (
        labelled.withColumn("_friction", spread + fee_bps)
        .withColumn("y_path", F.when(F.col("_friction") > 0, ratio(F.col("raw_net_bps"), F.col("_friction"))))
        .withColumn("mask", F.col("_exit_seq").isNotNull() & F.col("y_path").isNotNull())
        .drop("_exit_seq", "_exit_bid", "_friction")
    )


def with_labels(
    ticks: DataFrame,
    keys: Sequence[str],
    time: str,
    seq: str,
    *,
    horizon_us: int = HORIZON_US,
    order_ticks: int = ORDER_TICKS,
    order_us: int = ORDER_US,
) -> DataFrame:
    """Both labels. One pass over chunks flags the fills and notes each tick's predecessor, which the as-of pass uses."""
    lean = ticks.select(*keys, seq, time, "bid1", "ask1", "sell_min_price")
    filled = fill_flag(
        lean, keys, time, seq, sell_min="sell_min_price", limit_price="bid1",
        max_rows=order_ticks, max_us=order_us, previous="_previous",
    )
    return path_label(
        filled, keys, time, seq, horizon_us=horizon_us, keep=["sell_min_price", "y_fill"], previous="_previous"
    )
