"""Order-book features as Columns.

Level arrays ``bid_px, ask_px, bid_qty, ask_qty`` hold the best level first. Functions that
take a window look back along the tick sequence of one symbol-day. The unit of each feature
is in :data:`UNITS`; the fee is the round-trip cost in basis points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.numeric import ratio, ratio_if_positive

FEE_BPS = 23.0
LEVEL_COLUMNS = ("bid_px", "ask_px", "bid_qty", "ask_qty")

# The unit of measurement of each column.
UNITS = {
    "spread_bps": "return",
    "book_imbalance": "dimensionless",
    "queue_imbalance_best": "dimensionless",
    "microprice_dev_bps": "return",
    "microprice_velocity": "return",
    "spread_to_round_trip_cost_ratio": "dimensionless",
    "ask_depth_concentration": "dimensionless",
    "bid_depth_concentration": "dimensionless",
    "deep_depth_imbalance_6_10": "dimensionless",
    "signed_aggr_flow_20": "dimensionless",
    "mid_return_5t_bps": "return",
    "mid_return_20t_bps": "return",
    "ofi_cks_1": "quantity",
    "ofi_depth_5": "quantity",
    "ofi_depth_10": "quantity",
    "bid_queue_depth_at_l1": "quantity",
    "bid_depth_total_5": "quantity",
    "book_imbalance_velocity": "dimensionless",
    "trade_event_indicator": "boolean",
    "bid_best_price_drop_count_50t": "count",
    "mid_return_100t_bps": "return",
    "signed_aggr_flow_100": "dimensionless",
    "qbar": "quantity",
    "ofi_over_qbar_5": "dimensionless",
    "ofi_over_qbar_10": "dimensionless",
    "ofi_l1_over_qbar": "dimensionless",
    "bid_l1_depth_over_qbar": "dimensionless",
    "microprice_velocity_over_spread": "dimensionless",
    "mid_return_5t_over_spread": "dimensionless",
    "mid_return_20t_over_spread": "dimensionless",
    "mid_return_100t_over_spread": "dimensionless",
    "ofi_depth_5_zscore": "dimensionless",
    "microprice_velocity_zscore": "dimensionless",
}


def level(side: str, i: int) -> Column:
    return F.element_at(F.col(side), i)


def level_sum(side: str, first: int, last: int) -> Column:
    return F.expr(" + ".join(f"{side}[{i - 1}]" for i in range(first, last + 1)))


def mid() -> Column:
    return (level("bid_px", 1) + level("ask_px", 1)) / 2.0


def spread_bps() -> Column:
    gap = level("ask_px", 1) - level("bid_px", 1)
    return F.when(mid() > 0, ratio(gap * 1e4, mid()))


def imbalance(bid: Column, ask: Column) -> Column:
    return ratio(bid - ask, bid + ask)


def book_imbalance() -> Column:
    return imbalance(level("bid_qty", 1), level("ask_qty", 1))


def queue_imbalance_best() -> Column:
    return ratio(level("bid_qty", 1), level("bid_qty", 1) + level("ask_qty", 1))


def microprice_dev_bps() -> Column:
    return spread_bps() * book_imbalance() / 2.0


def microprice() -> Column:
    """Mid price leaning to the side with less resting size."""
    bid, ask = level("bid_qty", 1), level("ask_qty", 1)
    return ratio(level("ask_px", 1) * bid + level("bid_px", 1) * ask, bid + ask)


def spread_to_cost(fee_bps: float = FEE_BPS) -> Column:
    return ratio(spread_bps(), spread_bps() + fee_bps)


def depth_concentration(side: str) -> Column:
    return ratio(level(f"{side}_qty", 1), level_sum(f"{side}_qty", 1, 10))


def deep_depth_imbalance(first: int = 6, last: int = 10) -> Column:
    return imbalance(level_sum("bid_qty", first, last), level_sum("ask_qty", first, last))


def bid_queue_depth() -> Column:
    return level("bid_qty", 1)


def bid_depth_total(levels: int = 5) -> Column:
    return level_sum("bid_qty", 1, levels)


def vamp_bbo() -> Column:
    """Volume-adjusted mid of the best quotes: each price weighted by the other side's size."""
    return microprice()


# --- along the tick sequence -------------------------------------------------


def change(value: str, window: WindowSpec, lag: int = 1) -> Column:
    return F.col(value) - F.lag(value, lag).over(window)


def lagged_return_bps(price: str, window: WindowSpec, lag: int) -> Column:
    return (ratio(F.col(price), F.lag(price, lag).over(window)) - 1.0) * 1e4


def _full(value: Column, result: Column, window: WindowSpec, size: int) -> Column:
    frame = window.rowsBetween(-(size - 1), 0)
    return F.when(F.count(value).over(frame) == size, result.over(frame))


def rolling_mean(value: str, window: WindowSpec, size: int) -> Column:
    """Mean of the last ``size`` rows; NULL until the window is full or if a value is missing."""
    return _full(F.col(value), F.avg(value), window, size)


def rolling_sum(value: str, window: WindowSpec, size: int) -> Column:
    return _full(F.col(value), F.sum(value), window, size)


def rolling_std(value: str, window: WindowSpec, size: int, ddof: int = 1) -> Column:
    spread = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    return _full(F.col(value), spread, window, size)


def rolling_zscore(
    value: str,
    window: WindowSpec,
    size: int = 100,
    min_observations: int = 20,
    include_current: bool = True,
    ddof: int = 1,
) -> Column:
    frame = window.rowsBetween(-(size - 1), 0) if include_current else window.rowsBetween(-size, -1)
    spread = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    score = ratio(F.col(value) - F.avg(value).over(frame), spread.over(frame))
    return F.when(F.count(value).over(frame) >= min_observations, score)


def with_rolling(
    df: DataFrame,
    window: WindowSpec,
    requests: dict[str, tuple[str, str, int]],
    *,
    zscore_min: int = 20,
    zscore_include_current: bool = True,
) -> DataFrame:
    """Add rolling columns ``out: (kind, value, size)``; kinds are mean, sum, std and zscore.

    Every size takes the frame itself. Differences of running sums would cost less on long frames, but
    they lose the spread of large values and carry a NaN to every later row.
    """
    direct = {"mean": rolling_mean, "sum": rolling_sum, "std": rolling_std}
    return df.withColumns(
        {
            out: rolling_zscore(value, window, size, zscore_min, zscore_include_current)
            if kind == "zscore"
            else direct[kind](value, window, size)
            for out, (kind, value, size) in requests.items()
        }
    )


def previous_levels(df: DataFrame, window: WindowSpec) -> DataFrame:
    """Add the previous quote's level arrays, which :func:`order_flow_imbalance` reads."""
    return df.withColumns({f"_prev_{c}": F.lag(c, 1).over(window) for c in LEVEL_COLUMNS})


def order_flow_imbalance(levels: int) -> Column:
    """Net change of resting demand since the previous quote, summed over the first levels.

    Written as SQL text: ten levels would be hundreds of Column objects.
    """
    term = (
        "if(bid_px[{i}] >= _prev_bid_px[{i}], bid_qty[{i}], 0D)"
        " - if(bid_px[{i}] <= _prev_bid_px[{i}], _prev_bid_qty[{i}], 0D)"
        " - if(ask_px[{i}] <= _prev_ask_px[{i}], ask_qty[{i}], 0D)"
        " + if(ask_px[{i}] >= _prev_ask_px[{i}], _prev_ask_qty[{i}], 0D)"
    )
    total = " + ".join(f"({term.format(i=i)})" for i in range(levels))
    return F.expr(f"CASE WHEN _prev_bid_px IS NOT NULL THEN {total} END")


def signed_flow(window: WindowSpec, size: int, buy: str = "buy_volume", sell: str = "sell_volume") -> Column:
    frame = window.rowsBetween(-(size - 1), 0)
    bought, sold = F.sum(buy).over(frame), F.sum(sell).over(frame)
    return F.when(F.count(F.lit(1)).over(frame) == size, imbalance(bought, sold))


def price_dropped(price: str, window: WindowSpec) -> Column:
    """1.0 where ``price`` is below its previous value; NULL on the first row."""
    return (F.col(price) < F.lag(price, 1).over(window)).cast("double")


def trade_event_indicator(buy: str = "buy_volume", sell: str = "sell_volume") -> Column:
    return ((F.col(buy) + F.col(sell)) > 0).cast("double")


def traded_volume(buy: str = "buy_volume", sell: str = "sell_volume") -> Column:
    return F.col(buy) + F.col(sell)


def over_qbar(value: Column, qbar: Column) -> Column:
    return ratio_if_positive(value, qbar)


def over_spread(value: Column, spread: Column) -> Column:
    return ratio_if_positive(value, spread)
