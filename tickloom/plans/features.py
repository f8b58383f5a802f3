"""Feature matrix of a tick sequence in one pass over chunked windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import book
from tickloom.functions.numeric import ratio
from tickloom.operators.frames import CHUNK_ROWS, over_rows


@dataclass(frozen=True)
class Windows:
    """Row counts of the rolling definitions; the defaults are the standard ones."""

    qbar: int = 100
    zscore: int = 100
    zscore_min: int = 20
    flows: tuple[int, ...] = (20, 100)
    drops: int = 50
    lags: tuple[int, ...] = (5, 20, 100)
    zscore_include_current: bool = True

    @property
    def reach(self) -> int:
        return 1 + max(self.qbar, self.zscore, self.drops, *self.flows, *self.lags)


def level_features(df: DataFrame) -> DataFrame:
    """Features of one quote on its own."""
    return df.withColumns(
        {
            "mid": book.mid(),
            "spread_bps": book.spread_bps(),
            "book_imbalance": book.book_imbalance(),
            "queue_imbalance_best": book.queue_imbalance_best(),
            "microprice": book.microprice(),
            "microprice_dev_bps": book.microprice_dev_bps(),
            "spread_to_round_trip_cost_ratio": book.spread_to_cost(),
            "ask_depth_concentration": book.depth_concentration("ask"),
            "bid_depth_concentration": book.depth_concentration("bid"),
            "deep_depth_imbalance_6_10": book.deep_depth_imbalance(),
            "bid_queue_depth_at_l1": book.bid_queue_depth(),
            "bid_depth_total_5": book.bid_depth_total(5),
            "vamp_bbo": book.vamp_bbo(),
        }
    )


def feature_matrix(
    quotes: DataFrame,
    keys: Sequence[str],
    seq: str,
    sizes: Windows = Windows(),
    *,
    trades: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """All features. With ``trades=False`` the trade-dependent ones are absent, not zero.

    The best prices ``bid1, ask1`` are taken from the level arrays where they are not columns already.
    """
    best = {"bid1": book.level("bid_px", 1), "ask1": book.level("ask_px", 1)}
    quotes = quotes.withColumns({n: c for n, c in best.items() if n not in quotes.columns})

    def build(df: DataFrame, w) -> DataFrame:
        first = {
            "microprice_velocity": book.lagged_return_bps("microprice", w, 1),
            "book_imbalance_velocity": book.change("book_imbalance", w),
            "ofi_cks_1": book.order_flow_imbalance(1),
            "ofi_depth_5": book.order_flow_imbalance(5),
            "ofi_depth_10": book.order_flow_imbalance(10),
            "_dropped": book.price_dropped("bid1", w),
            **{f"mid_return_{k}t_bps": book.lagged_return_bps("mid", w, k) for k in sizes.lags},
        }
        rolling = {
            "qbar": ("mean", "bid_queue_depth_at_l1", sizes.qbar),
            f"bid_best_price_drop_count_{sizes.drops}t": ("sum", "_dropped", sizes.drops),
            "ofi_depth_5_zscore": ("zscore", "ofi_depth_5", sizes.zscore),
            "microprice_velocity_zscore": ("zscore", "microprice_velocity", sizes.zscore),
        }
        second = {}
        if trades:
            first["trade_event_indicator"] = book.trade_event_indicator()
            first["vol_flow"] = book.traded_volume()
            second |= {f"signed_aggr_flow_{k}": book.signed_flow(w, k) for k in sizes.flows}
        third = {
            "ofi_over_qbar_5": ratio(F.col("ofi_depth_5"), F.col("qbar")),
            "ofi_over_qbar_10": ratio(F.col("ofi_depth_10"), F.col("qbar")),
            "ofi_l1_over_qbar": ratio(F.col("ofi_cks_1"), F.col("qbar")),
            "bid_l1_depth_over_qbar": ratio(F.col("bid_queue_depth_at_l1"), F.col("qbar")),
            "microprice_velocity_over_spread": ratio(F.col("microprice_velocity"), F.col("spread_bps")),
            **{
                f"mid_return_{k}t_over_spread": ratio(F.col(f"mid_return_{k}t_bps"), F.col("spread_bps"))
                for k in sizes.lags
            },
        }
        staged = book.with_rolling(
            book.previous_levels(df, w).withColumns(first),
            w,
            rolling,
            zscore_min=sizes.zscore_min,
            zscore_include_current=sizes.zscore_include_current,
        )
        staged = staged.withColumns(second) if second else staged
        return staged.withColumns(third).drop("_dropped", *[f"_prev_{c}" for c in book.LEVEL_COLUMNS])

    return over_rows(
        level_features(quotes), keys, seq, build, before=sizes.reach, chunk_rows=chunk_rows
    )
