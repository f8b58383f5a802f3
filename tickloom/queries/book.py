"""Registered queries on the derived order book."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tickloom.functions import book as feature
from tickloom.functions.numeric import drop_incomplete, positive
from tickloom.operators import filters, metrics
from tickloom.operators.frames import over_rows
from tickloom.operators.positions import sorted_positions
from tickloom.operators.windows import causal_windows
from tickloom.plans import formulas, laws, references, strata
from tickloom.plans.features import Windows, feature_matrix, level_features
from tickloom.queries.bindings import B_SQL, DAY_US, KEYS, book, raw_ticks
from tickloom.queries.registry import query, r6, rounded
from tickloom.sources import ticks as source

WITH_B = f"WITH {B_SQL}"
SIZES = Windows(qbar=10, zscore=10, zscore_min=5, flows=(10,), drops=10, lags=(2, 5, 10))
LAW_SIZES = laws.LawWindows(qbar=10, flow=10, vol=10, lags=(2, 5, 10), forward=5)
W = "OVER (PARTITION BY symbol ORDER BY tick_seq"


def frame(n: int) -> str:
    return f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(expr: str, col: str, n: int) -> str:
    return f"CASE WHEN count({col}) {frame(n)} = {n} THEN {expr} {frame(n)} END"


def _ofi_sql(depth: int) -> str:
    term = (
        "(CASE WHEN bid_px[i] >= pb[i] THEN bid_qty[i] ELSE 0 END)"
        " - (CASE WHEN bid_px[i] <= pb[i] THEN pbq[i] ELSE 0 END)"
        " - (CASE WHEN ask_px[i] <= pa[i] THEN ask_qty[i] ELSE 0 END)"
        " + (CASE WHEN ask_px[i] >= pa[i] THEN paq[i] ELSE 0 END)"
    )
    return f"CASE WHEN pb IS NOT NULL THEN list_sum([{term} FOR i IN range(1, {depth + 1})]) END"


LEVEL_CTE = """
f1 AS (SELECT *, (bid1 + ask1) / 2 AS mid, (ask1 - bid1) * 1e4 / ((bid1 + ask1) / 2) AS spread_bps,
         (bid_qty[1] - ask_qty[1]) / (bid_qty[1] + ask_qty[1]) AS book_imbalance,
         bid_qty[1] / (bid_qty[1] + ask_qty[1]) AS queue_imbalance_best,
         (ask1 * bid_qty[1] + bid1 * ask_qty[1]) / (bid_qty[1] + ask_qty[1]) AS microprice,
         ask_qty[1] / list_sum(ask_qty) AS ask_depth_concentration,
         bid_qty[1] / list_sum(bid_qty) AS bid_depth_concentration,
         (list_sum(bid_qty[6:10]) - list_sum(ask_qty[6:10])) / (list_sum(bid_qty[6:10]) + list_sum(ask_qty[6:10]))
           AS deep_depth_imbalance_6_10,
         bid_qty[1] AS bid_queue_depth_at_l1, list_sum(bid_qty[1:5]) AS bid_depth_total_5 FROM b)"""

FEATURE_CTE = f"""{LEVEL_CTE},
f2a AS (SELECT *, lag(bid_px) {W}) AS pb, lag(ask_px) {W}) AS pa, lag(bid_qty) {W}) AS pbq,
          lag(ask_qty) {W}) AS paq FROM f1),
f2 AS (SELECT *, (microprice / lag(microprice) {W}) - 1) * 1e4 AS microprice_velocity,
         microprice - lag(microprice) {W}) AS microprice_step,
         book_imbalance - lag(book_imbalance) {W}) AS book_imbalance_velocity,
         {_ofi_sql(1)} AS ofi_cks_1, {_ofi_sql(5)} AS ofi_depth_5, {_ofi_sql(10)} AS ofi_depth_10,
         CAST(bid1 < lag(bid1) {W}) AS INT) AS dropped,
         (mid / lag(mid, 2) {W}) - 1) * 1e4 AS mid_return_2t_bps,
         (mid / lag(mid, 5) {W}) - 1) * 1e4 AS mid_return_5t_bps,
         (mid / lag(mid, 10) {W}) - 1) * 1e4 AS mid_return_10t_bps,
         CAST(buy_volume + sell_volume > 0 AS INT)::DOUBLE AS trade_event_indicator,
         buy_volume + sell_volume AS vol_flow,
         spread_bps * book_imbalance / 2 AS microprice_dev_bps,
         spread_bps / (spread_bps + 23) AS spread_to_round_trip_cost_ratio FROM f2a),
f3 AS (SELECT *, {full('avg(bid_queue_depth_at_l1)', 'bid_queue_depth_at_l1', 10)} AS qbar,
         CAST({full('sum(dropped)', 'dropped', 10)} AS DOUBLE) AS bid_best_price_drop_count_10t,
         CASE WHEN count(ofi_depth_5) {frame(10)} >= 5 THEN (ofi_depth_5 - avg(ofi_depth_5) {frame(10)})
              / nullif(stddev_samp(ofi_depth_5) {frame(10)}, 0) END AS ofi_depth_5_zscore,
         CASE WHEN count(microprice_velocity) {frame(10)} >= 5 THEN (microprice_velocity
              - avg(microprice_velocity) {frame(10)}) / nullif(stddev_samp(microprice_velocity) {frame(10)}, 0) END
              AS microprice_velocity_zscore,
         CASE WHEN count(*) {frame(10)} = 10 THEN (sum(buy_volume) {frame(10)} - sum(sell_volume) {frame(10)})
              / nullif(sum(buy_volume) {frame(10)} + sum(sell_volume) {frame(10)}, 0) END AS signed_aggr_flow_10
       FROM f2),
f AS (SELECT *, ofi_depth_5 / qbar AS ofi_over_qbar_5, ofi_depth_10 / qbar AS ofi_over_qbar_10,
         ofi_cks_1 / qbar AS ofi_l1_over_qbar, bid_queue_depth_at_l1 / qbar AS bid_l1_depth_over_qbar,
         microprice_velocity / nullif(spread_bps, 0) AS microprice_velocity_over_spread,
         mid_return_2t_bps / nullif(spread_bps, 0) AS mid_return_2t_over_spread,
         mid_return_5t_bps / nullif(spread_bps, 0) AS mid_return_5t_over_spread,
         mid_return_10t_bps / nullif(spread_bps, 0) AS mid_return_10t_over_spread FROM f3)"""

# The same definitions over 40 rows.
LONG = 40
LONG_SIZES = Windows(qbar=LONG, zscore=LONG, zscore_min=5, flows=(10, LONG), drops=LONG, lags=(2, 5, 10))
LONG_LAW_SIZES = laws.LawWindows(qbar=LONG, flow=LONG, vol=LONG, lags=(2, 5, 10), forward=5)


def longer(cte: str) -> str:
    for short, long in (
        ("ROWS BETWEEN 9 PRECEDING", f"ROWS BETWEEN {LONG - 1} PRECEDING"),
        ("= 10 THEN", f"= {LONG} THEN"), ("signed_aggr_flow_10", f"signed_aggr_flow_{LONG}"),
        ("drop_count_10t", f"drop_count_{LONG}t"), ("lead(v1, 10)", f"lead(v1, {LONG})"),
    ):
        cte = cte.replace(short, long)
    return cte


def features(spark, sf):
    return feature_matrix(book(spark, sf), KEYS, "tick_seq", SIZES)


def _level_query(name: str, *columns: str, extra: str = "") -> None:
    out = ", ".join(f"round({c}, 6) AS {c}" for c in columns)

    @query(name, f"{WITH_B}, {LEVEL_CTE}{extra} SELECT event_id, {out} FROM {'g' if extra else 'f1'}")
    def run(spark, sf):
        from tickloom.queries.bindings import with_book

        # Features of one quote need no sequence, so the scan is the whole plan.
        one = level_features(with_book(raw_ticks(spark, sf)))
        return one.select("event_id", *[r6(c) for c in columns])


def _window_query(name: str, *columns: str) -> None:
    out = ", ".join(f"round({c}, 6) AS {c}" for c in columns)

    @query(name, f"{WITH_B}, {FEATURE_CTE} SELECT symbol, tick_seq, {out} FROM f")
    def run(spark, sf):
        return features(spark, sf).select("symbol", "tick_seq", *[r6(c) for c in columns])


_DERIVED = """, g AS (SELECT *, spread_bps * book_imbalance / 2 AS microprice_dev_bps,
    spread_bps / (spread_bps + 23) AS spread_to_round_trip_cost_ratio, microprice AS vamp_bbo FROM f1)"""
_level_query("x01_spread_bps", "spread_bps")
_level_query("x02_book_imbalance", "book_imbalance")
_level_query("x03_queue_imbalance_best", "queue_imbalance_best")
_level_query("x04_microprice_deviation", "microprice_dev_bps", extra=_DERIVED)
_window_query("x05_microprice_velocity", "microprice_velocity")
_level_query("x06_spread_to_round_trip_cost", "spread_to_round_trip_cost_ratio", extra=_DERIVED)
_level_query("x07_depth_concentration", "ask_depth_concentration", "bid_depth_concentration")
_level_query("x08_deep_depth_imbalance", "deep_depth_imbalance_6_10")
_window_query("x09_signed_aggressive_flow", "signed_aggr_flow_10")
_window_query("x10_mid_returns", "mid_return_2t_bps", "mid_return_5t_bps", "mid_return_10t_bps")
_window_query("x11_order_flow_imbalance", "ofi_cks_1", "ofi_depth_5", "ofi_depth_10")
_level_query("x12_bid_depth", "bid_queue_depth_at_l1", "bid_depth_total_5")
_window_query("x13_book_imbalance_velocity", "book_imbalance_velocity")
_window_query(
    "x14_event_features", "trade_event_indicator", "vol_flow", "bid_best_price_drop_count_10t"
)
_level_query("x14_volume_adjusted_mid", "vamp_bbo", extra=_DERIVED)
_window_query("x15_mean_queue_depth", "qbar")
_window_query("x16_flow_over_mean_depth", "ofi_over_qbar_5", "ofi_over_qbar_10", "ofi_l1_over_qbar")
_window_query(
    "x17_moves_over_spread",
    "mid_return_2t_over_spread",
    "mid_return_5t_over_spread",
    "mid_return_10t_over_spread",
    "microprice_velocity_over_spread",
)
_window_query("x18_bid_depth_over_mean_depth", "bid_l1_depth_over_qbar")
_window_query("x19_rolling_zscores", "ofi_depth_5_zscore", "microprice_velocity_zscore")


_LONG_COLUMNS = (
    "qbar", f"bid_best_price_drop_count_{LONG}t", f"signed_aggr_flow_{LONG}", "ofi_over_qbar_5", "bid_l1_depth_over_qbar",
    "ofi_depth_5_zscore", "microprice_velocity_zscore",
)


@query(
    "x20_long_windows",
    f"""{WITH_B}, {longer(FEATURE_CTE)} SELECT symbol, tick_seq,
        {', '.join(f'round({c}, 6) AS {c}' for c in _LONG_COLUMNS)} FROM f""",
)
def long_windows(spark, sf):
    made = feature_matrix(book(spark, sf), KEYS, "tick_seq", LONG_SIZES)
    return made.select("symbol", "tick_seq", *[r6(c) for c in _LONG_COLUMNS])


@query(
    "x00_feature_matrix",
    f"""{WITH_B}, {FEATURE_CTE} SELECT symbol, count(*) AS n, count(qbar) AS n_qbar,
        round(avg(spread_bps), 6) AS spread_bps, round(avg(ofi_over_qbar_5), 6) AS ofi_over_qbar_5,
        round(avg(ofi_depth_5_zscore), 6) AS ofi_depth_5_zscore,
        round(avg(mid_return_5t_over_spread), 6) AS mid_return_5t_over_spread,
        round(avg(signed_aggr_flow_10), 6) AS signed_aggr_flow_10 FROM f GROUP BY 1""",
)
def feature_matrix_by_symbol(spark, sf):
    names = [
        "spread_bps",
        "ofi_over_qbar_5",
        "ofi_depth_5_zscore",
        "mid_return_5t_over_spread",
        "signed_aggr_flow_10",
    ]
    return features(spark, sf).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("qbar").alias("n_qbar"),
        *[r6(F.avg(c), c) for c in names],
    )


# --- window primitives -------------------------------------------------------


def _primitive(name: str, out: str, build, before: int, after: int = 0, sql: str = "") -> None:
    @query(name, f"{WITH_B}, {FEATURE_CTE}, z AS (SELECT symbol, tick_seq, {sql} AS {out} FROM f) "
           f"SELECT symbol, tick_seq, round({out}, 6) AS {out} FROM z")
    def run(spark, sf):
        def add(d, w):
            return d.withColumn(out, build(w))

        base = features(spark, sf).select("symbol", "tick_seq", "mid", "microprice", "ofi_depth_5",
                                          "mid_return_2t_bps", "bid_queue_depth_at_l1")
        out_df = over_rows(base, KEYS, "tick_seq", add, before=before, after=after)
        return out_df.select("symbol", "tick_seq", r6(out))


_primitive("w01_lagged_return", "ret", lambda w: feature.lagged_return_bps("mid", w, 5), 5,
           sql=f"(mid / lag(mid, 5) {W}) - 1) * 1e4")
_primitive("w02_rolling_mean", "mean10", lambda w: feature.rolling_mean("bid_queue_depth_at_l1", w, 10), 9,
           sql=full("avg(bid_queue_depth_at_l1)", "bid_queue_depth_at_l1", 10))
_primitive("w03_rolling_sum", "sum10", lambda w: feature.rolling_sum("ofi_depth_5", w, 10), 9,
           sql=full("sum(ofi_depth_5)", "ofi_depth_5", 10))
_primitive("w04_rolling_std", "std10", lambda w: feature.rolling_std("mid_return_2t_bps", w, 10), 9,
           sql=full("stddev_samp(mid_return_2t_bps)", "mid_return_2t_bps", 10))
_primitive("w05_rolling_zscore_prior_rows", "z",
           lambda w: feature.rolling_zscore("ofi_depth_5", w, 10, 5, include_current=False), 10,
           sql=f"""CASE WHEN count(ofi_depth_5) {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) >= 5 THEN
               (ofi_depth_5 - avg(ofi_depth_5) {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
               / nullif(stddev_samp(ofi_depth_5) {W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) END""")
_primitive("w06_forward_shift", "ahead", lambda w: F.lead("mid_return_2t_bps", 5).over(w), 0, 5,
           sql=f"lead(mid_return_2t_bps, 5) {W})")
_primitive("w16_one_tick_change", "step", lambda w: feature.change("microprice", w), 1,
           sql=f"microprice - lag(microprice) {W})")


# --- filters -----------------------------------------------------------------


@query(
    "f01_valid_quote",
    f"{WITH_B} SELECT event_id, bid1, ask1 FROM b WHERE bid1 > 0 AND ask1 > 0 AND ask1 - event_id % 25 >= bid1",
)
def valid_quote(spark, sf):
    rows = _plain(spark, sf)
    return rows.filter(
        filters.valid_quote(F.col("bid1"), F.col("ask1") - F.col("event_id") % 25)
    ).select("event_id", "bid1", "ask1")


@query(
    "f02_strictly_valid_quote",
    f"{WITH_B} SELECT event_id, bid1, ask1 FROM b WHERE bid1 > 0 AND ask1 - event_id % 25 > bid1",
)
def strictly_valid_quote(spark, sf):
    rows = _plain(spark, sf)
    return rows.filter(
        filters.strictly_valid_quote(F.col("bid1"), F.col("ask1") - F.col("event_id") % 25)
    ).select("event_id", "bid1", "ask1")


def _plain(spark, sf):
    from tickloom.queries.bindings import with_book

    return with_book(raw_ticks(spark, sf))


@query(
    "f04_finite_rows",
    f"""{WITH_B}, z AS (SELECT event_id, vol / nullif(event_id % 7, 0) AS a, sell_min_price AS p FROM b)
        SELECT event_id, round(a, 6) AS a, p FROM z WHERE a IS NOT NULL AND p IS NOT NULL""",
)
def finite_rows(spark, sf):
    rows = _plain(spark, sf)
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    broken = rows.select(
        "event_id",
        F.when(F.col("event_id") % 7 == 0, inf)
        .otherwise(F.try_divide(F.col("vol"), F.col("event_id") % 7))
        .alias("a"),
        F.coalesce("sell_min_price", nan).alias("p"),
    )
    return drop_incomplete(broken, ["a", "p"]).select("event_id", r6("a"), "p")


@query("f06_columns_common_to_all_symbols", f"{WITH_B} SELECT event_id, bid1, ask1, vol FROM b")
def common_columns(spark, sf):
    rows = _plain(spark, sf).withColumn("only_some", F.when(F.col("symbol") % 2 == 0, F.col("vol")))
    wanted = ["bid1", "ask1", "only_some", "vol"]
    kept = filters.columns_seen_everywhere(rows, ["symbol"], wanted)
    return rows.select("event_id", *kept)


@query(
    "f07_dimensionless_columns",
    f"""{WITH_B}, {LEVEL_CTE} SELECT event_id, round(book_imbalance, 6) AS book_imbalance,
        round(queue_imbalance_best, 6) AS queue_imbalance_best,
        round(spread_bps / (spread_bps + 23), 6) AS spread_to_round_trip_cost_ratio,
        '{{"bid_queue_depth_at_l1":"dimension quantity","spread_bps":"dimension return","vol":"no dimension recorded"}}' AS dropped
        FROM f1""",
)
def dimensionless_columns(spark, sf):
    scored = level_features(_plain(spark, sf)).select(
        "event_id", "spread_bps", "book_imbalance", "queue_imbalance_best", "bid_queue_depth_at_l1",
        "spread_to_round_trip_cost_ratio", "vol",
    )
    kept, dropped = filters.dimensionless(filters.with_units(scored, feature.UNITS), ["event_id"])
    reasons = F.create_map(*[F.lit(x) for item in sorted(dropped.items()) for x in item])
    return rounded(kept.withColumn("dropped", F.to_json(reasons)))


@query(
    "f08_tradable_price_or_missing",
    f"""{WITH_B} SELECT event_id, CASE WHEN event_id % 5 <> 0 AND bid1 > 9950 THEN bid1 - 9950 END AS price FROM b""",
)
def tradable_price_or_missing(spark, sf):
    shaky = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("bid1") - 9950)
    return _plain(spark, sf).select("event_id", positive(shaky).alias("price"))


# --- symbol statistics -------------------------------------------------------

STATS_CTE = f"""
mv AS (SELECT *, (ask1 - bid1) / ((bid1 + ask1) / 2) * 1e4 AS sp,
         abs(((bid1 + ask1) / 2) / lag((bid1 + ask1) / 2, 5) {W}) - 1) * 1e4 AS rv FROM b),
st AS (SELECT symbol, count(*) AS n_quote, quantile_cont(sp, 0.5) AS spread_bps,
         quantile_cont(ask_qty[1], 0.5) AS ask1_depth, coalesce(quantile_cont(rv, 0.5), 0) AS rv_bps
       FROM mv GROUP BY 1 HAVING count(*) >= 60)"""
STRATA_CTE = f"""{STATS_CTE},
cuts AS (SELECT quantile_cont(spread_bps, 1.0/3) AS c1, quantile_cont(spread_bps, 2.0/3) AS c2 FROM st),
fr AS (SELECT st.*, CASE WHEN spread_bps <= c1 THEN 'L' WHEN spread_bps <= c2 THEN 'M' ELSE 'H' END AS friction
       FROM st, cuts),
sm AS (SELECT friction, quantile_cont(ask1_depth, 0.5) AS md FROM fr GROUP BY 1),
sa AS (SELECT fr.*, CASE WHEN ask1_depth <= md THEN 'shallow' ELSE 'deep' END AS depth FROM fr JOIN sm USING (friction))"""


def symbol_stats(spark, sf):
    rows = book(spark, sf).select(
        "symbol", "tick_seq", "bid1", "ask1", feature.level("ask_qty", 1).alias("ask1_qty")
    )
    return strata.liquidity_stats(rows, KEYS, "tick_seq", min_quotes=60, move_lag=5)


@query(
    "a01_liquidity_statistics",
    f"""{WITH_B}, {STATS_CTE} SELECT symbol, n_quote, round(spread_bps, 6) AS spread_bps,
        round(ask1_depth, 6) AS ask1_depth, round(rv_bps, 6) AS rv_bps FROM st""",
)
def liquidity_statistics(spark, sf):
    return rounded(symbol_stats(spark, sf))


@query(
    "a02_friction_tertiles",
    f"{WITH_B}, {STRATA_CTE} SELECT symbol, round(spread_bps, 6) AS spread_bps, friction FROM fr",
)
def friction_tertiles(spark, sf):
    return strata.friction_layers(symbol_stats(spark, sf)).select("symbol", r6("spread_bps"), "friction")


@query(
    "a03_strata",
    f"{WITH_B}, {STRATA_CTE} SELECT symbol, friction, depth, friction || '-' || depth AS stratum FROM sa",
)
def strata_query(spark, sf):
    return strata.assign_strata(symbol_stats(spark, sf)).select("symbol", "friction", "depth", "stratum")


GAPS = ", ".join(
    f"CASE WHEN {s}[{i}] > 0 AND {s}[{i + 1}] > 0 THEN abs({s}[{i + 1}] - {s}[{i}]) END"
    for s in ("ask_px", "bid_px") for i in range(1, 5)
)
COVARIATES_CTE = f"""
ok AS (SELECT * FROM b WHERE bid1 > 0 AND ask1 > bid1
       AND symbol IN (SELECT symbol FROM b WHERE bid1 > 0 AND ask1 > bid1 GROUP BY 1 HAVING count(*) >= 50)),
gp AS (SELECT symbol, unnest([{GAPS}]) AS gap FROM ok),
gc AS (SELECT symbol, gap, count(*) AS n FROM gp WHERE gap > 0 GROUP BY 1, 2),
tk AS (SELECT symbol, arg_max(gap, (n, -gap)) AS tick, max(n) / sum(n) AS tick_share FROM gc GROUP BY 1),
cv AS (SELECT ok.symbol, any_value(tick) AS tick, any_value(tick_share) AS tick_share,
         avg((ask1 - bid1) / tick) AS mean_spread_ticks, avg(CAST(ask1 - bid1 = tick AS INT)) AS frac_one_tick,
         count(*) AS n_quotes, quantile_cont((bid1 + ask1) / 2, 0.5) AS median_price,
         max(vol * 100 + tick_seq) AS traded_value
       FROM ok JOIN tk USING (symbol) GROUP BY 1)"""


def covariates(spark, sf):
    rows = book(spark, sf).withColumn("turnover", F.col("vol") * 100 + F.col("tick_seq"))
    return strata.symbol_covariates(rows, "symbol")


@query(
    "a15_symbol_covariates",
    f"""{WITH_B}, {COVARIATES_CTE} SELECT symbol, tick, round(tick_share, 6) AS tick_share,
        round(mean_spread_ticks, 6) AS mean_spread_ticks, round(frac_one_tick, 6) AS frac_one_tick, n_quotes,
        round(median_price, 6) AS median_price, traded_value, round(tick * 1e4 / median_price, 6) AS rel_tick_bps,
        tick IS NOT NULL AS ok FROM cv""",
)
def symbol_covariates(spark, sf):
    return rounded(covariates(spark, sf))


@query(
    "f13_known_tick_size",
    f"""{WITH_B}, {COVARIATES_CTE} SELECT count(*) AS symbols, count(*) FILTER (tick_share < 0.5) AS excluded FROM cv""",
)
def known_tick_size(spark, sf):
    table = covariates(spark, sf)
    return table.agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count_if(F.col("tick_share") < strata.MIN_TICK_SHARE).alias("excluded"),
    )


@query(
    "a37_spearman_of_covariates",
    f"""{WITH_B}, {COVARIATES_CTE}, rk AS (SELECT rank() OVER (ORDER BY mean_spread_ticks) +
          (count(*) OVER (PARTITION BY mean_spread_ticks) - 1) / 2.0::DOUBLE AS rx,
          rank() OVER (ORDER BY traded_value) + (count(*) OVER (PARTITION BY traded_value) - 1) / 2.0::DOUBLE AS ry FROM cv)
        SELECT round(corr(rx, ry), 6) AS spearman FROM rk""",
)
def spearman_of_covariates(spark, sf):
    return rounded(metrics.spearman(covariates(spark, sf), "mean_spread_ticks", "traded_value"))


@query(
    "a41_tertile_groups",
    f"""{WITH_B}, {COVARIATES_CTE} SELECT symbol,
        ntile(3) OVER (ORDER BY mean_spread_ticks, frac_one_tick DESC, symbol) - 1 AS tick_group,
        ntile(3) OVER (ORDER BY traded_value, symbol) - 1 AS liq_group FROM cv""",
)
def tertile_groups(spark, sf):
    return strata.tertile_groups(covariates(spark, sf), "symbol")


# --- law datasets and measurements -------------------------------------------

LAW_CTE = f"""{FEATURE_CTE},
lw AS (SELECT *, {full('sum(ofi_depth_5)', 'ofi_depth_5', 10)} AS flow,
         {full('sum(buy_volume - sell_volume)', 'buy_volume', 10)} AS signed,
         {full('stddev_samp(mid_return_2t_bps)', 'mid_return_2t_bps', 10)} AS v0,
         {full('stddev_samp(mid_return_5t_bps)', 'mid_return_5t_bps', 10)} AS v1,
         {full('stddev_samp(mid_return_10t_bps)', 'mid_return_10t_bps', 10)} AS v2 FROM f),
law1 AS (SELECT symbol, tick_seq, book_imbalance AS x1, spread_to_round_trip_cost_ratio AS x2,
           (lead(mid, 5) {W}) / mid - 1) * 1e4 / spread_bps AS y FROM lw),
law2 AS (SELECT symbol, tick_seq, flow / qbar AS x1,
           CASE WHEN true THEN mid_return_5t_bps / spread_bps END AS y FROM lw),
law3 AS (SELECT symbol, tick_seq, signed / qbar AS x1, v0 / spread_bps AS x2, mid_return_5t_bps / spread_bps AS y FROM lw),
law4 AS (SELECT symbol, tick_seq, v0 / spread_bps AS x1, v1 / spread_bps AS x2, v2 / spread_bps AS x3,
           lead(v1, 10) {W}) / spread_bps AS y FROM lw)"""


def _law_query(name: str, table: str, xs: tuple[str, ...], build, cte=LAW_CTE, sizes=LAW_SIZES) -> None:
    cols = (*xs, "y")
    out = ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    mask = " AND ".join(f"{c} IS NOT NULL" for c in cols)

    @query(name, f"{WITH_B}, {cte} SELECT symbol, tick_seq, {out}, {mask} AS mask FROM {table}")
    def run(spark, sf):
        made = build(book(spark, sf), KEYS, "tick_seq", sizes)
        return made.select("symbol", "tick_seq", *[r6(c) for c in cols], "mask")


_law_query("m03_microprice_law_dataset", "law1", ("x1", "x2"), laws.microprice_law)
_law_query("m04_flow_law_dataset", "law2", ("x1",), laws.flow_law)
_law_query("m05_impact_law_dataset", "law3", ("x1", "x2"), laws.impact_law)
_law_query("m06_volatility_law_dataset", "law4", ("x1", "x2", "x3"), laws.volatility_law)
_law_query("m04_flow_law_long", "law2", ("x1",), laws.flow_law, longer(LAW_CTE), LONG_LAW_SIZES)
_law_query("m05_impact_law_long", "law3", ("x1", "x2"), laws.impact_law, longer(LAW_CTE), LONG_LAW_SIZES)
_law_query("m06_volatility_law_long", "law4", ("x1", "x2", "x3"), laws.volatility_law, longer(LAW_CTE), LONG_LAW_SIZES)


INTENSITY_CTE = """
tr AS (SELECT symbol, t_us, row_number() OVER (PARTITION BY symbol ORDER BY t_us, event_id) AS tick_seq
       FROM b WHERE side <> 'quote'),
g1 AS (SELECT *, (t_us - lag(t_us) OVER w) / 1e6 AS dt_prev, (lead(t_us) OVER w - t_us) / 1e6 AS dt_next
       FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY tick_seq)),
rc AS (SELECT p.symbol, p.tick_seq, count(q.tick_seq) AS recent FROM tr p LEFT JOIN tr q ON p.symbol = q.symbol
       AND q.tick_seq < p.tick_seq AND q.t_us >= p.t_us - 86400000000 GROUP BY 1, 2),
g2 AS (SELECT g1.*, recent, coalesce(dt_prev > 1e-6 AND dt_next > 1e-6, false) AS valid,
         CASE WHEN dt_next > 0 THEN 1 / dt_next END AS rate FROM g1 JOIN rc USING (symbol, tick_seq)),
cp AS (SELECT symbol, quantile_cont(rate, 0.99) AS cap, count(rate) AS known FROM g2 GROUP BY 1),
md AS (SELECT symbol, quantile_cont(dt_prev, 0.5) AS med FROM g2 WHERE valid GROUP BY 1),
law5 AS (SELECT symbol, tick_seq, dt_prev / med AS x1, recent * med AS x2,
           CASE WHEN known > 10 THEN least(rate, cap) ELSE rate END * med AS y0, rate, valid
         FROM g2 JOIN cp USING (symbol) JOIN md USING (symbol)),
law5m AS (SELECT symbol, tick_seq, x1, x2, CASE WHEN rate IS NOT NULL THEN y0 END AS y, valid FROM law5)"""


def trades(spark, sf):
    rows = raw_ticks(spark, sf).filter(F.col("side") != "quote").select("symbol", "event_id", "t_us")
    return source.sequence_ticks(rows, KEYS, "t_us", ["event_id"], DAY_US)


def intensity(spark, sf):
    return laws.intensity_law(
        trades(spark, sf), KEYS, "t_us", "tick_seq", recent_us=DAY_US, bucket_us=4 * DAY_US
    )


@query(
    "m07_intensity_law_dataset",
    f"""{WITH_B}, {INTENSITY_CTE} SELECT symbol, tick_seq, round(x1, 6) AS x1, round(x2, 3) AS x2,
        round(y, 6) AS y, valid AND y IS NOT NULL AND x1 IS NOT NULL AS mask FROM law5m""",
)
def intensity_law_dataset(spark, sf):
    made = intensity(spark, sf)
    return made.select("symbol", "tick_seq", r6("x1"), r6("x2", digits=3), r6("y"), "mask")


@query(
    "m08_unusable_symbols",
    f"""{WITH_B}, {LAW_CTE}, r AS (SELECT symbol, count(*) AS n_rows,
          count(*) FILTER (x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND y IS NOT NULL) AS n_valid
          FROM law4 GROUP BY 1)
        SELECT symbol, n_rows, n_valid, CASE WHEN n_rows < 60 THEN 'fewer than 60 rows'
               WHEN n_valid = 0 THEN 'no usable row' END AS reason FROM r""",
)
def unusable_symbols(spark, sf):
    made = laws.volatility_law(book(spark, sf), KEYS, "tick_seq", LAW_SIZES)
    return laws.symbol_report(made, "symbol", min_rows=60)


BINS_CTE = """
l1 AS (SELECT x1, y FROM law1 WHERE y IS NOT NULL),
re AS (SELECT quantile_cont(abs(x1), 0.95) AS reach FROM l1),
bn AS (SELECT CAST(greatest(least(floor((x1 + reach) / (2 * reach) * 40), 39), 0) AS BIGINT) AS bin, x1, y FROM l1, re),
bm AS (SELECT bin, count(*) AS n, avg(x1) AS mean_x, avg(y) AS mean_y FROM bn GROUP BY 1 HAVING count(*) >= 5)"""


def law_bins(spark, sf):
    made = laws.microprice_law(book(spark, sf), KEYS, "tick_seq", LAW_SIZES)
    return laws.symmetric_bins(made, "x1", "y")


@query(
    "a24_symmetric_bin_means",
    f"""{WITH_B}, {LAW_CTE}, {BINS_CTE} SELECT bin, n, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y FROM bm""",
)
def symmetric_bin_means(spark, sf):
    return rounded(law_bins(spark, sf))


@query(
    "m09_odd_monotone_law",
    f"""{WITH_B}, {LAW_CTE}, {BINS_CTE},
        rk AS (SELECT bin, mean_y, rank() OVER (ORDER BY mean_y) AS ry FROM bm),
        mi AS (SELECT a.*, b.mean_y AS my FROM rk a LEFT JOIN bm b ON b.bin = 39 - a.bin),
        o AS (SELECT count(*) AS n_bins_filled, corr(bin, ry) AS rho,
                quantile_cont(CASE WHEN my IS NOT NULL THEN abs(mean_y + my) / greatest(abs(mean_y), abs(my)) END, 0.5) AS oe FROM mi)
        SELECT n_bins_filled, round(rho, 6) AS spearman, round(oe, 6) AS odd_error, abs(rho) >= 0.9 AS monotone,
               oe <= 0.3 AS odd, n_bins_filled < 32 AS ambiguous,
               n_bins_filled >= 32 AND abs(rho) >= 0.9 AND oe <= 0.3 AS passed FROM o""",
)
def odd_monotone_law(spark, sf):
    return rounded(laws.measure_odd_monotone(law_bins(spark, sf)))


LOG_BINS_CTE = """
l5 AS (SELECT x1, y FROM law5m WHERE valid AND y IS NOT NULL AND x1 > 0),
en AS (SELECT quantile_cont(x1, 0.02) AS lo, quantile_cont(x1, 0.98) AS hi FROM l5),
lb AS (SELECT CAST(greatest(least(floor((ln(x1) - ln(lo)) / (ln(hi) - ln(lo)) * 50), 49), 0) AS BIGINT) AS bin, x1, y
       FROM l5, en),
lm AS (SELECT bin, count(*) AS n, avg(x1) AS mean_x, avg(y) AS mean_y FROM lb GROUP BY 1 HAVING count(*) >= 5)"""


@query(
    "a25_log_bin_means",
    f"""{WITH_B}, {INTENSITY_CTE}, {LOG_BINS_CTE}
        SELECT bin, n, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y FROM lm""",
)
def log_bin_means(spark, sf):
    return rounded(laws.log_bins(intensity(spark, sf), "x1", "y"))


GRID = laws.decay_grid(steps=12)
GRID_SQL = ", ".join(f"({r!r}::DOUBLE)" for r in GRID)


@query(
    "m13_decay_law",
    f"""{WITH_B}, {INTENSITY_CTE}, {LOG_BINS_CTE}, gr AS (SELECT * FROM (VALUES {GRID_SQL}) t(rate)),
        ft AS (SELECT 'exponential' AS form, rate, regr_r2(mean_y, exp(mean_x * -rate)) AS r2 FROM lm, gr GROUP BY 1, 2
          UNION ALL SELECT 'power', rate, regr_r2(mean_y, pow(mean_x + 1e-6, -rate)) FROM lm, gr GROUP BY 1, 2),
        bs AS (SELECT form, max(r2) AS r2, arg_max(rate, r2) AS rate FROM ft GROUP BY 1),
        o AS (SELECT (SELECT count(*) FROM lm) AS n, (SELECT regr_r2(mean_y, mean_x) FROM lm) AS lr,
          max(r2) FILTER (form = 'exponential') AS er, max(rate) FILTER (form = 'exponential') AS ea,
          max(r2) FILTER (form = 'power') AS pr, max(rate) FILTER (form = 'power') AS pa FROM bs)
        SELECT n AS n_bins_filled, round(er, 6) AS exponential_r2, round(ea, 6) AS exponential_rate,
          round(pr, 6) AS power_r2, round(pa, 6) AS power_rate, round(lr, 6) AS linear_r2,
          CASE WHEN er >= pr THEN 'exponential' ELSE 'power' END AS chosen,
          n < 30 OR greatest(er, pr) < 0.7 AS ambiguous,
          NOT (n < 30 OR greatest(er, pr) < 0.7) AND greatest(er, pr) - lr >= 0.03 AS passed FROM o""",
)
def decay_law(spark, sf):
    return rounded(laws.measure_decay(laws.log_bins(intensity(spark, sf), "x1", "y"), GRID))


HALF_LOG_BINS = LOG_BINS_CTE.replace("WHERE valid AND", "WHERE symbol % 2 = 0 AND valid AND")


@query(
    "m17_decay_reference",
    f"""{WITH_B}, {INTENSITY_CTE}, {HALF_LOG_BINS}, gr AS (SELECT * FROM (VALUES {GRID_SQL}) t(rate)),
        sh AS (SELECT 'exponential' AS form, rate, mean_y, exp(mean_x * -rate) AS c FROM lm, gr
          UNION ALL SELECT 'power', rate, mean_y, pow(mean_x + 1e-6, -rate) FROM lm, gr),
        ft AS (SELECT form, rate, regr_r2(mean_y, c) AS r2, regr_slope(mean_y, c) AS b, regr_intercept(mean_y, c) AS a FROM sh GROUP BY 1, 2),
        bs AS (SELECT * FROM ft ORDER BY r2 DESC, form, rate DESC LIMIT 1),
        z AS (SELECT y, a + b * CASE WHEN form = 'exponential' THEN exp(least(greatest(x1, lo), hi) * -rate)
                ELSE pow(least(greatest(x1, lo), hi) + 1e-6, -rate) END AS pred
              FROM law5m, en, bs WHERE symbol % 2 = 1 AND valid AND y IS NOT NULL AND x1 > 0)
        SELECT count(*) AS n, round(avg(pred), 6) AS mean_pred,
          round(1 - sum((y - pred) * (y - pred)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2 FROM z""",
)
def decay_reference(spark, sf):
    """Fitted on even symbols, scored on odd ones."""
    made = intensity(spark, sf).filter("mask")
    fit, score = (made.filter(F.col("symbol") % 2 == half) for half in (0, 1))
    scored = references.decay(fit, score, "x1", "y", GRID).na.drop(subset=["y", "pred"])
    return scored.agg(
        F.count("pred").alias("n"), r6(F.avg("pred"), "mean_pred"),
        r6(metrics.weighted_r2(F.col("y"), F.col("pred"), F.lit(1.0)), "r2"),
    )


# --- formulas ----------------------------------------------------------------

FORMULAS = {
    "c1": "x1",
    "c2": "-0.5 * x1",
    "c3": "x1 * x2",
    "c4": "tanh(x1) - x2",
    "c5": "x1 / (x2 - x2)",
    "c6": "no_such_column + 1",
}


def _r2_sql(expr: str) -> str:
    known = f"FILTER ({expr} IS NOT NULL AND y IS NOT NULL)"
    return (
        f"1 - sum((y - ({expr})) * (y - ({expr}))) {known} / "
        f"(sum(y * y) {known} - sum(y) {known} * sum(y) {known} / count(*) {known})"
    )


@query(
    "m15_formula_scores",
    f"""{WITH_B}, {LAW_CTE} {' UNION ALL '.join(
        f"SELECT '{k}' AS formula_id, round({_r2_sql(v)}, 6) AS r2 FROM law1" for k, v in list(FORMULAS.items())[:4])}
        UNION ALL SELECT 'c5', NULL UNION ALL SELECT 'c6', NULL""",
)
def formula_scores(spark, sf):
    made = laws.microprice_law(book(spark, sf), KEYS, "tick_seq", LAW_SIZES).withColumn("w", F.lit(1.0))
    return rounded(formulas.score_formulas(made, FORMULAS, "y", "w"))


RESPONSES = {"c1": "({0})", "c2": "-0.5 * ({0})", "c3": "({0}) * m", "c4": "tanh({0}) - m"}


def _response_sql(name: str) -> str:
    form = RESPONSES[name]
    up, down, mid = (form.format(x) for x in ("pos + step", "pos - step", "pos"))
    return (
        f"SELECT '{name}' AS formula_id, point, round(pos, 6) AS \"at\", round({mid}, 6) AS value, "
        f"round((({up}) - ({down})) / (2 * step), 6) AS slope FROM gr"
    )


@query(
    "m14_formula_response",
    f"""{WITH_B}, {LAW_CTE}, o AS (SELECT x1, x2 FROM law1 WHERE y IS NOT NULL),
        q AS (SELECT quantile_cont(x1, 0.02) AS lo, quantile_cont(x1, 0.98) AS hi, quantile_cont(x2, 0.5) AS m FROM o),
        gr AS (SELECT point, lo + (hi - lo) * point / 40 AS pos, (hi - lo) * 1e-4 AS step, m FROM q, range(41) r(point))
        {' UNION ALL '.join(_response_sql(n) for n in RESPONSES)}""",
)
def formula_response(spark, sf):
    made = laws.microprice_law(book(spark, sf), KEYS, "tick_seq", LAW_SIZES).filter("mask")
    return rounded(
        formulas.response_curves(
            made, {k: FORMULAS[k] for k in ("c1", "c2", "c3", "c4")}, sweep="x1", others=["x2"]
        )
    )


@query(
    "m14_formula_slope_constancy",
    f"""{WITH_B}, {LAW_CTE}, o AS (SELECT x1, x2 FROM law1 WHERE y IS NOT NULL),
        q AS (SELECT quantile_cont(x1, 0.02) AS lo, quantile_cont(x1, 0.98) AS hi, quantile_cont(x2, 0.5) AS m FROM o)
        SELECT 'c1' AS formula_id, 41::BIGINT AS points, 1.0::DOUBLE AS slope_mean, 0.0::DOUBLE AS slope_cv FROM q
        UNION ALL SELECT 'c2', 41, -0.5, 0.0 FROM q UNION ALL SELECT 'c3', 41, round(m, 6), 0.0 FROM q""",
)
def formula_slope_constancy(spark, sf):
    made = laws.microprice_law(book(spark, sf), KEYS, "tick_seq", LAW_SIZES).filter("mask")
    curves = formulas.response_curves(
        made, {k: FORMULAS[k] for k in ("c1", "c2", "c3")}, sweep="x1", others=["x2"]
    )
    return rounded(formulas.slope_constancy(curves))


SEARCH_INPUTS = ["x1", "x2", "x3"]


def _candidates_sql() -> str:
    """One row per template and combination of the ranked inputs, with the squared correlation of its values."""
    rows = []
    for name, arity, form, size in formulas.TEMPLATES:
        for combo in combinations((1, 2, 3), arity):
            text = "'" + form.format(*[f"' || n{i} || '" for i in combo]) + "'"
            value = form.format(*[f"s{i}" for i in combo])
            rows.append(f"SELECT {text} AS formula, '{name}' AS template, {size} AS complexity, corr({value}, y) AS r FROM vals, nm GROUP BY n1, n2, n3")
    return " UNION ALL ".join(rows)


@query(
    "m16_template_formula_search",
    f"""{WITH_B}, {LAW_CTE}, ok AS (SELECT x1, x2, x3, y FROM law4 WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND y IS NOT NULL),
        st AS (SELECT 'x1' AS input, abs(corr(x1, y)) AS r FROM ok UNION ALL SELECT 'x2', abs(corr(x2, y)) FROM ok
               UNION ALL SELECT 'x3', abs(corr(x3, y)) FROM ok),
        rk AS (SELECT input, row_number() OVER (ORDER BY r DESC, input) AS k FROM st),
        nm AS (SELECT max(input) FILTER (k = 1) AS n1, max(input) FILTER (k = 2) AS n2, max(input) FILTER (k = 3) AS n3 FROM rk),
        vals AS (SELECT y, {', '.join(f"CASE n{i} WHEN 'x1' THEN x1 WHEN 'x2' THEN x2 ELSE x3 END AS s{i}" for i in (1, 2, 3))} FROM ok, nm),
        cd AS ({_candidates_sql()})
        SELECT formula, template, complexity::INTEGER AS complexity, round(r * r, 6) AS score FROM cd WHERE r IS NOT NULL
        ORDER BY r * r DESC, cd.complexity, formula LIMIT 12""",
)
def template_formula_search(spark, sf):
    made = laws.volatility_law(book(spark, sf), KEYS, "tick_seq", LAW_SIZES).withColumn("w", F.lit(1.0))
    return rounded(formulas.template_search(made.filter("mask"), SEARCH_INPUTS, "y", "w"))


WINDOWED_CTE = f"""
wn AS (SELECT symbol, tick_seq, {', '.join(
    f"coalesce(lag({c}, {k}) {W}), first_value({c}) {W})) AS w{(3 - k) * 2 + j}"
    for k in (3, 2, 1, 0) for j, c in enumerate(("book_imbalance", "spread_bps")))} FROM f1)"""


def windowed(spark, sf):
    rows = level_features(book(spark, sf))
    return causal_windows(rows, KEYS, "tick_seq", ["book_imbalance", "spread_bps"], size=4)


@query(
    "a33_windowed_input_moments",
    f"""{WITH_B}, {LEVEL_CTE}, {WINDOWED_CTE} {' UNION ALL '.join(
        f"SELECT {i} AS place, round(avg(w{i}), 6) AS mean, round(stddev_pop(w{i}), 6) AS scale FROM wn"
        for i in range(8))}""",
)
def windowed_input_moments(spark, sf):
    return rounded(metrics.column_moments(windowed(spark, sf), "window", 8))


MODEL = [0.5, -0.01, 0.25, 0.02, -0.75, 0.03, 1.0, -0.04]


@query(
    "m19_score_stored_linear_model",
    f"""{WITH_B}, {LEVEL_CTE}, {WINDOWED_CTE} SELECT symbol, tick_seq,
        round(0.125 + {' + '.join(f'{b} * w{i}' for i, b in enumerate(MODEL))}, 6) AS score FROM wn""",
)
def score_stored_linear_model(spark, sf):
    scored = formulas.score_linear(windowed(spark, sf), "window", MODEL, 0.125)
    return scored.select("symbol", "tick_seq", r6("score"))
