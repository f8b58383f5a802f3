"""Registered queries on events read as ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.clock import SESSION_END, SESSION_START, micros_to_packed, packed_to_seconds
from tickloom.functions.numeric import ratio
from tickloom.operators import windows as win
from tickloom.operators.asof import fill_flag, forward_asof, lookback_count
from tickloom.operators.frames import forward_fill, over_rows
from tickloom.operators.positions import shuffled_positions
from tickloom.operators.quantiles import grouped_quantiles
from tickloom.plans import labels as label_plan
from tickloom.queries.bindings import B_SQL, DAY_US, E_SQL, KEYS, book, raw_ticks, ticks, with_book
from tickloom.queries.registry import draw_sql, query, r6, rounded
from tickloom.session import cut_lineage
from tickloom.sources import tables as store
from tickloom.sources import ticks as source

WITH_E = f"WITH {E_SQL}"
WITH_B = f"WITH {B_SQL}"
HOUR_US = 3_600_000_000

PACKED_SQL = """
pk AS (SELECT *, ((s // 3600) * 10000 + (s // 60 % 60) * 100 + s % 60) * 1000000 + t_us % 1000000 AS local_time
       FROM (SELECT *, (t_us % 86400000000) // 1000000 AS s FROM e))"""


def packed(df):
    return df.withColumn("local_time", micros_to_packed(F.col("t_us") % DAY_US))


@query(
    "s03_session_quote_scan",
    f"""{WITH_E}, {PACKED_SQL} SELECT symbol, event_id, local_time FROM pk
        WHERE side = 'quote' AND local_time BETWEEN {SESSION_START} AND {SESSION_END}""",
)
def session_quote_scan(spark, sf):
    rows = source.session_quotes(packed(raw_ticks(spark, sf)), is_quote=F.col("side") == "quote")
    return rows.select("symbol", "event_id", "local_time")


@query(
    "s04_session_trade_scan",
    f"""{WITH_E}, {PACKED_SQL} SELECT symbol, event_id, local_time,
        row_number() OVER (PARTITION BY symbol ORDER BY t_us, event_id) AS trade_seq FROM pk
        WHERE side <> 'quote' AND local_time >= {SESSION_START} AND local_time < {SESSION_END}""",
)
def session_trade_scan(spark, sf):
    rows = source.session_trades(packed(raw_ticks(spark, sf)), is_trade=F.col("side") != "quote")
    ordered = source.sequence_ticks(rows, KEYS, "t_us", ["event_id"], DAY_US)
    return ordered.select("symbol", "event_id", "local_time", F.col("tick_seq").alias("trade_seq"))


@query(
    "s05_packed_clock_to_seconds",
    f"{WITH_E} SELECT event_id, round((t_us % 86400000000) / 1e6, 6) AS seconds FROM e",
)
def packed_clock_to_seconds(spark, sf):
    return packed(raw_ticks(spark, sf)).select(
        "event_id", r6(packed_to_seconds(F.col("local_time")), "seconds")
    )


def _grid_sql(attach: str) -> str:
    shift = 1 if attach == "next" else 0
    return f"""{WITH_B}, c AS (SELECT *, count(*) FILTER (side = 'quote') OVER (PARTITION BY symbol
            ORDER BY tick_seq ROWS UNBOUNDED PRECEDING) AS nq FROM b),
        g AS (SELECT *, CASE WHEN side = 'quote' THEN nq ELSE nq + {shift} END AS cell FROM c)
        SELECT symbol, max(tick_seq) FILTER (side = 'quote') AS tick_seq,
               max(bid1) FILTER (side = 'quote') AS bid1,
               sum(buy_volume) AS buy_volume, sum(sell_volume) AS sell_volume,
               max(ask1) FILTER (side = 'buy') AS buy_max_price, min(bid1) FILTER (side = 'sell') AS sell_min_price
        FROM g GROUP BY symbol, cell HAVING count(*) FILTER (side = 'quote') = 1"""


def _grid(spark, sf, attach):
    side = F.col("side")
    return source.quote_grid(
        book(spark, sf),
        KEYS,
        "tick_seq",
        is_quote=side == "quote",
        is_buy=side == "buy",
        is_sell=side == "sell",
        price=F.when(side == "buy", F.col("ask1")).otherwise(F.col("bid1")),
        volume=F.col("vol"),
        carry=["bid1"],
        attach=attach,
    )


@query("s06_quote_grid_next", _grid_sql("next"))
def quote_grid_next(spark, sf):
    return _grid(spark, sf, "next")


@query("s06_quote_grid_prev", _grid_sql("prev"))
def quote_grid_prev(spark, sf):
    return _grid(spark, sf, "prev")


def _raw_days(spark, sf):
    """All events as raw rows of two trading days, by the parity of their own day."""
    frame = with_book(raw_ticks(spark, sf))
    quote = F.col("side") == "quote"
    levels = {
        f"{side}{i}_{kind}": F.when(quote, F.element_at(f"{side}_{short}", i))
        for side in ("ask", "bid") for kind, short in (("price", "px"), ("quantity", "qty")) for i in range(1, 11)
    }
    return packed(frame).select(
        F.concat(F.lit("2024010"), (1 + F.floor(F.col("t_us") / DAY_US) % 2).cast("string")).alias("date"),
        F.lpad(F.col("symbol").cast("string"), 6, "0").alias("code"),
        F.concat(F.lit("issue"), "symbol").alias("name"),
        "event_id",
        F.when(quote, source.QUOTE_ROW).otherwise(source.TRADE_ROW).alias("data_type"),
        "local_time",
        F.when(F.col("side") == "buy", source.BUY_LED).when(F.col("side") == "sell", source.SELL_LED).alias("askbid_type"),
        F.when(F.col("side") == "buy", F.col("ask1")).when(F.col("side") == "sell", F.col("bid1")).alias("trade_price"),
        F.when(~quote, F.col("vol")).alias("trade_quantity"),
        F.lit(None).cast("double").alias("cumulative_trading_amount"),
        *[c.alias(n) for n, c in levels.items()],
    )


@query(
    "s06_raw_files_to_grid",
    f"""{WITH_B}, d AS (SELECT *, '2024010' || CAST(1 + (t_us // 86400000000) % 2 AS VARCHAR) AS date FROM b),
        o AS (SELECT * REPLACE (row_number() OVER (PARTITION BY symbol, date ORDER BY t_us % 86400000000, event_id) AS tick_seq) FROM d),
        c AS (SELECT *, count(*) FILTER (side = 'quote') OVER (PARTITION BY symbol, date
            ORDER BY tick_seq ROWS UNBOUNDED PRECEDING) AS nq FROM o),
        g AS (SELECT *, CASE WHEN side = 'quote' THEN nq ELSE nq + 1 END AS cell FROM c)
        SELECT date, lpad(CAST(symbol AS VARCHAR), 6, '0') AS symbol, max(tick_seq) FILTER (side = 'quote') AS tick_seq,
               max(bid1) FILTER (side = 'quote') AS bid1, max(ask_qty[10]) FILTER (side = 'quote') AS ask_qty10,
               sum(buy_volume) AS buy_volume, sum(sell_volume) AS sell_volume,
               max(ask1) FILTER (side = 'buy') AS buy_max_price, min(bid1) FILTER (side = 'sell') AS sell_min_price
        FROM g GROUP BY date, symbol, cell HAVING count(*) FILTER (side = 'quote') = 1""",
)
def raw_files_to_grid(spark, sf):
    """Writes one raw file per symbol-day, then loads each day through its own part of the listed manifest."""
    root = store.scratch_path(spark, "raw")
    source.write_tick_files(_raw_days(spark, sf), root, order=("local_time", "event_id"))
    grids, dates = [], ("20240101", "20240102")
    manifest = source.file_manifest(spark, root, dates)
    for date in dates:
        files = source.sole_files(manifest.filter(F.col("date") == date))
        rows = source.level_arrays(source.load_ticks(spark, files)).withColumns({"bid1": F.get("bid_px", F.lit(0)), "ask_qty10": F.get("ask_qty", F.lit(9))})
        keys = ["date", "symbol"]
        # Read by every step below; each of very many small files is opened once.
        lean = [*keys, "t_us", "file_row", "data_type", "askbid_type", "trade_price", "trade_quantity", "bid1", "ask_qty10"]
        ordered = source.sequence_ticks(cut_lineage(rows.select(*lean)), keys, "t_us", ["file_row"], DAY_US)
        trade = F.col("data_type") == source.TRADE_ROW
        grids.append(
            source.quote_grid(
                ordered,
                keys,
                "tick_seq",
                is_quote=F.col("data_type") == source.QUOTE_ROW,
                is_buy=trade & (F.col("askbid_type") == source.BUY_LED),
                is_sell=trade & (F.col("askbid_type") == source.SELL_LED),
                price=F.col("trade_price"),
                volume=F.col("trade_quantity"),
                carry=["bid1", "ask_qty10"],
            )
        )
    return grids[0].unionByName(grids[1])


# --- filters -----------------------------------------------------------------


@query(
    "f03_drop_thin_symbols",
    f"{WITH_E} SELECT symbol, count(*) AS n FROM e WHERE side = 'quote' GROUP BY 1 HAVING count(*) >= 14",
)
def drop_thin_symbols(spark, sf):
    quotes = raw_ticks(spark, sf).filter(F.col("side") == "quote")
    return quotes.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 14)


@query(
    "f05_time_slice_after_windows",
    f"""{WITH_E}, w AS (SELECT *, avg(score) OVER (PARTITION BY symbol ORDER BY tick_seq
            ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m, count(*) OVER (PARTITION BY symbol ORDER BY tick_seq
            ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n FROM e)
        SELECT symbol, tick_seq, round(CASE WHEN n = 10 THEN m END, 6) AS mean10 FROM w
        WHERE t_us % 86400000000 >= 12 * 3600000000""",
)
def time_slice_after_windows(spark, sf):
    from tickloom.functions.book import rolling_mean

    def build(d, w):
        return d.withColumn("mean10", rolling_mean("score", w, 10))

    whole = over_rows(ticks(spark, sf), KEYS, "tick_seq", build, before=9)
    afternoon = whole.filter(F.col("t_us") % DAY_US >= 12 * HOUR_US)
    return afternoon.select("symbol", "tick_seq", r6("mean10"))


@query(
    "f09_winsorise_upper_tail",
    f"""{WITH_E}, q AS (SELECT symbol, quantile_cont(score, 0.99) AS cap FROM e GROUP BY 1)
        SELECT symbol, event_id, round(least(score, cap), 6) AS score FROM e JOIN q USING (symbol)""",
)
def winsorise_upper_tail(spark, sf):
    from tickloom.operators.filters import winsorise

    capped = winsorise(raw_ticks(spark, sf), ["symbol"], "score", 0.99)
    return capped.select("symbol", "event_id", r6("score"))


# --- as-of and interval operators --------------------------------------------


@query(
    "j04_forward_asof",
    f"""{WITH_E} SELECT p.symbol, p.tick_seq, min(q.tick_seq) AS found_seq,
        round(arg_min(q.score, q.tick_seq), 6) AS found_score
        FROM e p LEFT JOIN e q ON p.symbol = q.symbol AND q.t_us >= p.t_us + 21600000000
        GROUP BY 1, 2""",
)
def forward_asof_query(spark, sf):
    found = forward_asof(
        ticks(spark, sf),
        KEYS,
        "t_us",
        "tick_seq",
        horizon_us=6 * HOUR_US,
        take={"found_seq": "tick_seq", "found_score": "score"},
        bucket_us=DAY_US,
    )
    return found.select("symbol", "tick_seq", "found_seq", r6("found_score"))


FILL_SQL = """
fl AS (SELECT p.symbol, p.tick_seq, max(CASE WHEN q.sell_min_price <= p.bid1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit
       FROM b p LEFT JOIN b q ON p.symbol = q.symbol AND q.tick_seq BETWEEN p.tick_seq + 1 AND p.tick_seq + 10
            AND q.t_us <= p.t_us + 43200000000 AND q.sell_min_price > 0
       GROUP BY 1, 2)"""


@query(
    "j05_fill_window",
    f"{WITH_B}, {FILL_SQL} SELECT symbol, tick_seq, hit AS y_fill FROM fl",
)
def fill_window(spark, sf):
    flagged = fill_flag(
        book(spark, sf).select("symbol", "tick_seq", "t_us", "bid1", "sell_min_price"),
        KEYS,
        "t_us",
        "tick_seq",
        sell_min="sell_min_price",
        limit_price="bid1",
        max_rows=10,
        max_us=12 * HOUR_US,
    )
    return flagged.select("symbol", "tick_seq", "y_fill")


@query(
    "j06_lookback_count",
    f"""{WITH_E} SELECT p.symbol, p.tick_seq, count(q.tick_seq) AS recent_count
        FROM e p LEFT JOIN e q ON p.symbol = q.symbol AND q.tick_seq < p.tick_seq AND q.t_us >= p.t_us - 86400000000
        GROUP BY 1, 2""",
)
def lookback_count_query(spark, sf):
    counted = lookback_count(
        ticks(spark, sf), KEYS, "t_us", "tick_seq", span_us=DAY_US, bucket_us=4 * DAY_US
    )
    return counted.select("symbol", "tick_seq", "recent_count")


@query(
    "j10_attach_scores_and_verify",
    f"""{WITH_B}, sc AS (SELECT symbol, tick_seq, t_us,
            CASE WHEN event_id % 97 = 0 THEN bid1 + 5 ELSE bid1 END AS bid1, score FROM b)
        SELECT symbol, count(*) AS n, count(sc.score) AS scored,
               count(*) FILTER (sc.score IS NULL OR sc.t_us <> b.t_us OR sc.bid1 <> b.bid1) AS mismatches,
               round(avg(sc.score), 6) AS mean_score
        FROM b LEFT JOIN sc USING (symbol, tick_seq) GROUP BY 1""",
)
def attach_scores_and_verify(spark, sf):
    from tickloom.operators.joins import attach_scores

    frame = book(spark, sf).select("symbol", "tick_seq", "t_us", "bid1", "event_id", "score")
    scores = frame.select(
        "symbol",
        "tick_seq",
        "t_us",
        F.when(F.col("event_id") % 97 == 0, F.col("bid1") + 5).otherwise(F.col("bid1")).alias("bid1"),
        "score",
    )
    joined = attach_scores(frame.drop("score"), scores, ["symbol", "tick_seq"], ["t_us", "bid1"], "score")
    return joined.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("score").alias("scored"),
        F.count_if("mismatch").alias("mismatches"),
        r6(F.avg("score"), "mean_score"),
    )


# --- windows and signals -----------------------------------------------------

W_SQL = "OVER (PARTITION BY symbol ORDER BY tick_seq"
PRIOR_SQL = f"""
pq AS (SELECT *, list_sort(list(score) {W_SQL} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS prior FROM e),
cut AS (SELECT symbol, tick_seq, score, CASE WHEN len(prior) = 20 THEN prior[15] END AS q70,
               CASE WHEN len(prior) = 20 THEN prior[18] END AS q85,
               CASE WHEN len(prior) = 20 THEN prior[20] END AS q95 FROM pq)"""
CUTS = {"q70": 0.70, "q85": 0.85, "q95": 0.95}


def with_cuts(spark, sf):
    return win.with_prior_quantiles(
        ticks(spark, sf).select("symbol", "tick_seq", "score"), KEYS, "tick_seq", "score", CUTS, size=20
    )


@query(
    "w07_prior_quantile",
    f"{WITH_E}, {PRIOR_SQL} SELECT symbol, tick_seq, q70 FROM cut",
)
def prior_quantile(spark, sf):
    return with_cuts(spark, sf).select("symbol", "tick_seq", "q70")


@query(
    "w08_prior_quantile_grid",
    f"{WITH_E}, {PRIOR_SQL} SELECT symbol, tick_seq, q70, q85, q95 FROM cut",
)
def prior_quantile_grid(spark, sf):
    return with_cuts(spark, sf).drop("score")


@query(
    "w09_signals",
    f"""{WITH_E}, {PRIOR_SQL} SELECT symbol, tick_seq, score IS NOT NULL AS sig_all, score > 0 AS sig_abs,
        coalesce(score > q70, false) AS sig_q70, coalesce(score > q85, false) AS sig_q85,
        coalesce(score > q95, false) AS sig_q95 FROM cut""",
)
def signals(spark, sf):
    cut = with_cuts(spark, sf)
    rules = win.signal_rules("score", list(CUTS))
    return cut.select("symbol", "tick_seq", *[c.alias(n) for n, c in rules.items()])


@query(
    "w10_event_gaps",
    f"""{WITH_E}, tr AS (SELECT symbol, t_us, row_number() OVER (PARTITION BY symbol ORDER BY t_us, event_id) AS tick_seq
            FROM e WHERE side <> 'quote'),
        g AS (SELECT symbol, tick_seq, (t_us - lag(t_us) {W_SQL})) / 1e6 AS dt_prev,
            (lead(t_us) {W_SQL}) - t_us) / 1e6 AS dt_next FROM tr)
        SELECT symbol, tick_seq, round(dt_prev, 6) AS dt_prev, round(dt_next, 6) AS dt_next FROM g
        WHERE dt_prev > 1e-6 AND dt_next > 1e-6""",
)
def event_gaps(spark, sf):
    from tickloom.operators.asof import neighbour_gaps

    def build(d, w):
        return neighbour_gaps(d, w, "t_us")

    rows = raw_ticks(spark, sf).filter(F.col("side") != "quote").select("symbol", "event_id", "t_us")
    trades = source.sequence_ticks(rows, KEYS, "t_us", ["event_id"], DAY_US)
    gaps = over_rows(trades.select("symbol", "tick_seq", "t_us"), KEYS, "tick_seq", build, before=1, after=1)
    valid = gaps.filter(
        (F.col("dt_prev") > win.MIN_GAP_SECONDS) & (F.col("dt_next") > win.MIN_GAP_SECONDS)
    )
    return valid.select("symbol", "tick_seq", r6("dt_prev"), r6("dt_next"))


@query(
    "w11_run_ids",
    f"""{WITH_E}, c AS (SELECT *, CASE WHEN tick_seq > 1 AND side <> lag(side) {W_SQL}) THEN 1 ELSE 0 END AS ch FROM e)
        SELECT symbol, tick_seq, CAST(sum(ch) {W_SQL}) AS BIGINT) AS run_id FROM c""",
)
def run_id_query(spark, sf):
    runs = win.run_ids(ticks(spark, sf).select("symbol", "tick_seq", "side"), KEYS, "tick_seq", "side")
    return runs.select("symbol", "tick_seq", "run_id")


FILL_FORWARD_SQL = f"""
ff AS (SELECT symbol, tick_seq, coalesce(last_value(CASE WHEN side = 'quote' THEN score END IGNORE NULLS) {W_SQL}
              ROWS UNBOUNDED PRECEDING), 0.0) AS f0,
              coalesce(last_value(CASE WHEN side = 'buy' THEN vol END IGNORE NULLS) {W_SQL}
              ROWS UNBOUNDED PRECEDING), 0.0) AS f1 FROM e)"""


def gappy(spark, sf):
    return ticks(spark, sf).select(
        "symbol",
        "tick_seq",
        "event_id",
        F.when(F.col("side") == "quote", F.col("score")).alias("f0"),
        F.when(F.col("side") == "buy", F.col("vol")).alias("f1"),
    )


@query("w12_forward_fill", f"{WITH_E}, {FILL_FORWARD_SQL} SELECT symbol, tick_seq, f0, f1 FROM ff")
def forward_fill_query(spark, sf):
    filled = forward_fill(gappy(spark, sf), KEYS, "tick_seq", ["f0", "f1"], default=0.0)
    return filled.select("symbol", "tick_seq", "f0", "f1")


CAUSAL_SQL = f"""
cw AS (SELECT symbol, tick_seq, {', '.join(
    f"coalesce(lag(f{j}, {k}) {W_SQL}), first_value(f{j}) {W_SQL})) AS w{(3 - k) * 2 + j}"
    for k in (3, 2, 1, 0) for j in (0, 1))} FROM ff)"""


@query(
    "w13_causal_windows",
    f"""{WITH_E}, {FILL_FORWARD_SQL}, {CAUSAL_SQL}
        SELECT symbol, tick_seq, {', '.join(f'w{i}' for i in range(8))} FROM cw""",
)
def causal_window_query(spark, sf):
    windows = win.causal_windows(gappy(spark, sf), KEYS, "tick_seq", ["f0", "f1"], size=4)
    return windows.select(
        "symbol", "tick_seq", *[F.element_at("window", i + 1).alias(f"w{i}") for i in range(8)]
    )


@query(
    "w14_causal_windows_of_sample",
    f"""{WITH_E}, {FILL_FORWARD_SQL}, {CAUSAL_SQL}
        SELECT symbol, tick_seq, {', '.join(f'w{i}' for i in range(8))} FROM cw
        WHERE {draw_sql(3, 'symbol', 'tick_seq')} < 429496729""",
)
def causal_windows_of_sample(spark, sf):
    from tickloom.functions.draws import draw

    picked = draw(3, F.col("symbol"), F.col("tick_seq")) < 429_496_729
    windows = win.sampled_causal_windows(
        gappy(spark, sf), KEYS, "tick_seq", ["f0", "f1"], picked, size=4
    )
    return windows.select(
        "symbol", "tick_seq", *[F.element_at("window", i + 1).alias(f"w{i}") for i in range(8)]
    )


@query(
    "w17_conditions_in_time",
    f"""{WITH_E}, a AS (SELECT *, score > 40 AS up, lag(score > 40) {W_SQL}) AS up0 FROM e)
        SELECT symbol, tick_seq, up AND coalesce(NOT up0, false) AS crossed,
               count(*) FILTER (score > 20) {W_SQL} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS held,
               (side = 'buy') AND (count(*) FILTER (side = 'sell') {W_SQL}
                   ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) > 0 AS followed FROM a""",
)
def conditions_in_time(spark, sf):
    side = F.col("side")

    def build(d, w):
        return d.withColumns(
            {
                "crossed": win.crossover(F.col("score"), F.lit(40.0), w),
                "held": win.persistence(F.col("score") > 20, w, 3),
                "followed": win.sequence_within(side == "sell", side == "buy", w, 4),
            }
        )

    out = over_rows(
        ticks(spark, sf).select("symbol", "tick_seq", "score", "side"), KEYS, "tick_seq", build, before=4
    )
    return out.select("symbol", "tick_seq", "crossed", "held", "followed")


# --- labels ------------------------------------------------------------------

PATH_SQL = """
ex AS (SELECT p.symbol, p.tick_seq, any_value(p.bid1) AS bid1, any_value(p.ask1) AS ask1,
              arg_min(q.bid1, q.tick_seq) AS exit_bid
       FROM b p LEFT JOIN b q ON p.symbol = q.symbol AND q.t_us >= p.t_us + 21600000000 GROUP BY 1, 2),
lab AS (SELECT symbol, tick_seq, (exit_bid / ask1 - 1) * 1e4 - 23 AS raw_net_bps,
               ((exit_bid / ask1 - 1) * 1e4 - 23) / ((ask1 - bid1) * 1e4 / ((bid1 + ask1) / 2) + 23) AS y_path
        FROM ex)"""


@query(
    "m01_path_label",
    f"""{WITH_B}, {PATH_SQL} SELECT symbol, tick_seq, round(raw_net_bps, 6) AS raw_net_bps,
        round(y_path, 6) AS y_path, y_path IS NOT NULL AS mask FROM lab""",
)
def path_label(spark, sf):
    labelled = label_plan.path_label(
        book(spark, sf), KEYS, "t_us", "tick_seq", horizon_us=6 * HOUR_US, bucket_us=DAY_US
    )
    return labelled.select("symbol", "tick_seq", r6("raw_net_bps"), r6("y_path"), "mask")


@query(
    "m02_path_and_fill_labels",
    f"""{WITH_B}, {PATH_SQL}, {FILL_SQL} SELECT symbol, tick_seq, round(y_path, 6) AS y_path, hit AS y_fill
        FROM lab JOIN fl USING (symbol, tick_seq)""",
)
def path_and_fill_labels(spark, sf):
    labelled = label_plan.with_labels(
        book(spark, sf),
        KEYS,
        "t_us",
        "tick_seq",
        horizon_us=6 * HOUR_US,
        order_ticks=10,
        order_us=12 * HOUR_US,
    )
    return labelled.select("symbol", "tick_seq", r6("y_path"), "y_fill")


# --- totals, samples, unions -------------------------------------------------


@query(
    "a38_usable_rows_rollup",
    f"""{WITH_E} SELECT day, stratum, count(*) AS n_rows, count(*) FILTER (side = 'quote') AS usable
        FROM (SELECT t_us // 86400000000 AS day, symbol % 6 AS stratum, side FROM e)
        GROUP BY ROLLUP (day, stratum)""",
)
def usable_rows_rollup(spark, sf):
    from tickloom.functions.clock import bucket_of

    frame = raw_ticks(spark, sf).select(
        bucket_of(F.col("t_us"), DAY_US).alias("day"), (F.col("symbol") % 6).alias("stratum"), "side"
    )
    return frame.rollup("day", "stratum").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("side") == "quote").alias("usable")
    )


@query(
    "a39_usable_share_in_window",
    f"""{WITH_E} SELECT symbol, round(avg(CAST(side = 'quote' AS INT)), 6) AS share_day,
        round(avg(CAST(side = 'quote' AS INT)) FILTER (t_us % 86400000000 < 43200000000), 6) AS share_window
        FROM e GROUP BY 1""",
)
def usable_share_in_window(spark, sf):
    usable = (F.col("side") == "quote").cast("double")
    early = F.col("t_us") % DAY_US < DAY_US // 2
    return raw_ticks(spark, sf).groupBy("symbol").agg(
        r6(F.avg(usable), "share_day"), r6(F.avg(F.when(early, usable)), "share_window")
    )


@query(
    "r01_seeded_sample",
    f"""{WITH_E} SELECT event_id FROM (SELECT event_id, row_number() OVER (
        ORDER BY {draw_sql(11, 'event_id')}, event_id) AS rn FROM e) WHERE rn <= 500""",
)
def seeded_sample(spark, sf):
    from tickloom.operators.sampling import sample_rows

    return sample_rows(raw_ticks(spark, sf).select("event_id"), ["event_id"], 500, seed=11)


@query(
    "u01_union_of_blocks",
    f"""{WITH_E} SELECT side AS block, symbol, count(*) AS n, round(sum(score), 4) AS total FROM e GROUP BY 1, 2""",
)
def union_of_blocks(spark, sf):
    from tickloom.operators.ranking import union_blocks

    frame = raw_ticks(spark, sf).select("symbol", "score", "side")
    blocks = {s: frame.filter(F.col("side") == s).drop("side") for s in ("quote", "buy", "sell")}
    return union_blocks(blocks, "block").groupBy("block", "symbol").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("score"), "total", 4)
    )
