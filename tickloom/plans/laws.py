"""Datasets and direct measurements of five microstructure laws.

Each dataset has the key columns, dimensionless inputs ``x1..``, outcome ``y`` and the raw
inputs, with ``mask`` marking usable rows. A measurement returns one row with the numbers and
the in-band decision.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import book
from tickloom.functions.numeric import ratio, ratio_if_positive
from tickloom.operators import metrics
from tickloom.operators.asof import lookback_count, neighbour_gaps
from tickloom.operators.frames import CHUNK_ROWS, over_rows
from tickloom.operators.moments import co_moments
from tickloom.operators.quantiles import grouped_quantiles
from tickloom.plans.features import level_features
from tickloom.session import cut_lineage

# Bands of the decisions.
MONOTONE_MIN = 0.9
ODD_ERROR_MAX = 0.3
DEGENERATE = 1e-9
SLOPE_CV_MAX = 0.15
EXPONENT_RANGE = (0.4, 0.7)
LOG_R2_MIN = 0.6
MULTI_R2_MIN = 0.85
MULTI_SLOPE_MIN = 1e-6
DECAY_R2_MIN = 0.7
DECAY_MARGIN_MIN = 0.03
MIN_ROWS = 50


@dataclass(frozen=True)
class LawWindows:
    qbar: int = 100
    flow: int = 20
    vol: int = 100
    lags: tuple[int, int, int] = (5, 20, 100)
    forward: int = 5

    @property
    def reach(self) -> int:
        return 1 + max(self.qbar, self.flow, self.vol + max(self.lags))


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    usable = F.col("spread_bps") > 0
    for c in columns:
        usable = usable & F.col(c).isNotNull()
    return df.withColumn("mask", F.coalesce(usable, F.lit(False)))


def _dataset(quotes, keys, seq, sizes, build, before, after, chunk_rows, columns):
    made = over_rows(
        level_features(quotes), keys, seq, build, before=before, after=after, chunk_rows=chunk_rows
    )
    return _complete(made, columns).select(*keys, seq, *columns, "mask")


def microprice_law(quotes, keys, seq, sizes=LawWindows(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Imbalance and relative cost against the next mid return over the current spread."""

    def build(df, w):
        ahead = (ratio(F.lead("mid", sizes.forward).over(w), F.col("mid")) - 1.0) * 1e4
        return df.withColumns(
            {
                "x1": F.col("book_imbalance"),
                "x2": F.col("spread_to_round_trip_cost_ratio"),
                "y": ratio_if_positive(ahead, F.col("spread_bps")),
            }
        )

    return _dataset(quotes, keys, seq, sizes, build, 0, sizes.forward, chunk_rows, ["x1", "x2", "y"])


def flow_law(quotes, keys, seq, sizes=LawWindows(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Order-flow imbalance over mean depth against the return of the same window."""

    def build(df, w):
        staged = book.previous_levels(df, w).withColumns(
            {
                "_ofi": book.order_flow_imbalance(5),
                "_ret": book.lagged_return_bps("mid", w, sizes.lags[1]),
            }
        )
        total = book.with_rolling(
            staged,
            w,
            {
                "_qbar": ("mean", "bid_queue_depth_at_l1", sizes.qbar),
                "_flow": ("sum", "_ofi", sizes.flow),
            },
        )
        return total.withColumns(
            {
                "x1": ratio_if_positive(F.col("_flow"), F.col("_qbar")),
                "y": ratio_if_positive(F.col("_ret"), F.col("spread_bps")),
            }
        )

    return _dataset(quotes, keys, seq, sizes, build, sizes.reach, 0, chunk_rows, ["x1", "y"])


def impact_law(quotes, keys, seq, sizes=LawWindows(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Signed traded volume over mean depth, and volatility, against the same window's return."""

    def build(df, w):
        staged = df.withColumns(
            {
                "_signed": F.col("buy_volume") - F.col("sell_volume"),
                "_fast": book.lagged_return_bps("mid", w, sizes.lags[0]),
                "_ret": book.lagged_return_bps("mid", w, sizes.lags[1]),
            }
        )
        total = book.with_rolling(
            staged,
            w,
            {
                "_qbar": ("mean", "bid_queue_depth_at_l1", sizes.qbar),
                "_vol": ("sum", "_signed", sizes.flow),
                "_sigma": ("std", "_fast", sizes.vol),
            },
        )
        return total.withColumns(
            {
                "x1": ratio_if_positive(F.col("_vol"), F.col("_qbar")),
                "x2": ratio_if_positive(F.col("_sigma"), F.col("spread_bps")),
                "y": ratio_if_positive(F.col("_ret"), F.col("spread_bps")),
            }
        )

    return _dataset(quotes, keys, seq, sizes, build, sizes.reach, 0, chunk_rows, ["x1", "x2", "y"])


def volatility_law(quotes, keys, seq, sizes=LawWindows(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Volatility at three scales against the middle one a window ahead."""

    def build(df, w):
        staged = df.withColumns(
            {f"_r{i}": book.lagged_return_bps("mid", w, k) for i, k in enumerate(sizes.lags)}
        )
        vols = book.with_rolling(
            staged, w, {f"_v{i}": ("std", f"_r{i}", sizes.vol) for i in range(3)}
        )
        spread = F.col("spread_bps")
        return vols.withColumns(
            {
                **{f"x{i + 1}": ratio_if_positive(F.col(f"_v{i}"), spread) for i in range(3)},
                "y": ratio_if_positive(F.lead("_v1", sizes.vol).over(w), spread),
            }
        )

    return _dataset(
        quotes, keys, seq, sizes, build, sizes.reach, sizes.vol, chunk_rows, ["x1", "x2", "x3", "y"]
    )


def intensity_law(
    trades: DataFrame,
    keys: Sequence[str],
    time: str,
    seq: str,
    *,
    recent_us: int = 1_000_000,
    bucket_us: int = 60_000_000,
    clip_quantile: float = 0.99,
    min_gap: float = 1e-6,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Gap to the previous trade and recent count against the intensity of the next one,
    in units of the symbol's median gap. Trades carry a dense ``seq`` of their own."""

    def gaps(df, w):
        return neighbour_gaps(df, w, time)

    lean = trades.select(*keys, seq, time)
    spaced = over_rows(lean, keys, seq, gaps, before=1, after=1, chunk_rows=chunk_rows)
    counted = lookback_count(spaced, keys, time, seq, span_us=recent_us, bucket_us=bucket_us)
    valid = (F.col("dt_prev") > min_gap) & (F.col("dt_next") > min_gap)
    # Read by two quantile jobs and the result, so the gaps are written once.
    rated = cut_lineage(
        counted.withColumns(
            {
                "_valid": F.coalesce(valid, F.lit(False)),
                "_rate": F.when(F.col("dt_next") > 0, ratio(F.lit(1.0), F.col("dt_next"))),
            }
        )
    )
    caps = grouped_quantiles(rated, keys, "_rate", {"_cap": clip_quantile}, count_as="_known")
    medians = grouped_quantiles(rated.filter("_valid"), keys, "dt_prev", {"_median": 0.5})
    # A symbol without a usable gap has no median: its rows stay, with NULLs and mask false.
    scaled = rated.join(caps, list(keys), "left").join(medians, list(keys), "left")
    capped = (F.col("_known") > 10) & (F.col("_rate") > F.col("_cap"))
    rate = F.when(capped, F.col("_cap")).otherwise(F.col("_rate"))
    return scaled.select(
        *keys,
        seq,
        ratio_if_positive(F.col("dt_prev"), F.col("_median")).alias("x1"),
        (F.col("recent_count") * F.col("_median")).alias("x2"),
        (rate * F.col("_median")).alias("y"),
        "_valid",
    ).select(
        *keys, seq, "x1", "x2", "y",
        (F.col("_valid") & F.col("y").isNotNull() & F.col("x1").isNotNull()).alias("mask"),
    )


def symbol_report(dataset: DataFrame, key: str, min_rows: int = 5) -> DataFrame:
    """Which symbols cannot be used and why; a failing symbol never fails the job."""
    counted = dataset.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("mask").alias("n_valid")
    )
    reason = (
        F.when(F.col("n_rows") < min_rows, f"fewer than {min_rows} rows")
        .when(F.col("n_valid") == 0, "no usable row")
    )
    return counted.withColumn("reason", reason)


# --- measurements ------------------------------------------------------------


def symmetric_bins(dataset: DataFrame, x: str, y: str, bins: int = 40, min_count: int = 5) -> DataFrame:
    """Conditional means over equal bins between plus and minus the 95th percentile of |x|."""
    rows = cut_lineage(dataset.filter("mask").select(x, y).withColumn("_abs", F.abs(F.col(x))))
    reach = grouped_quantiles(rows, [], "_abs", {"reach": 0.95}).select("reach").scalar()
    bounded = rows.withColumn("_reach", reach)
    return metrics.conditional_means(
        bounded, x, y, -F.col("_reach"), F.col("_reach"), bins, min_count
    )


def log_bins(dataset: DataFrame, x: str, y: str, bins: int = 50, min_count: int = 5) -> DataFrame:
    """Conditional means over log-spaced bins between the 2nd and 98th percentile of ``x``."""
    rows = cut_lineage(dataset.filter(F.col("mask") & (F.col(x) > 0)).select(x, y))
    ends = grouped_quantiles(rows, [], x, {"lo": 0.02, "hi": 0.98}).select(F.struct("lo", "hi")).scalar()
    low, high = F.ln("_e.lo"), F.ln("_e.hi")
    place = F.floor((F.ln(x) - low) / (high - low) * bins)
    index = F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("bigint")
    return (
        rows.withColumn("_e", ends)
        .withColumn("bin", index)
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))
        .filter(F.col("n") >= min_count)
    )


def measure_odd_monotone(bins: DataFrame, n_bins: int = 40) -> DataFrame:
    """Rank correlation with the bin place, and how far mirrored bins are from opposite.

    ``bins`` has at most ``n_bins`` rows, so the rank windows below are over a bounded table.
    """
    bins = cut_lineage(bins)
    every = Window.partitionBy(F.lit(0))
    tied = Window.partitionBy("mean_y")
    ranked = bins.withColumn(
        "ry", F.rank().over(every.orderBy("mean_y")) + (F.count(F.lit(1)).over(tied) - 1) / 2.0
    )
    mirror = bins.select((F.lit(n_bins - 1) - F.col("bin")).alias("bin"), F.col("mean_y").alias("mirror_y"))
    paired = ranked.join(mirror, "bin", "left")
    size = F.greatest(F.abs("mean_y"), F.abs("mirror_y"))
    error = F.abs(F.col("mean_y") + F.col("mirror_y")) / F.when(size < DEGENERATE, 1.0).otherwise(size)
    out = paired.agg(
        F.count(F.lit(1)).alias("n_bins_filled"),
        F.corr("bin", "ry").alias("spearman"),
        F.median(F.when(F.col("mirror_y").isNotNull(), error)).alias("odd_error"),
        F.max(F.abs("mean_y")).alias("scale"),
    )
    enough = F.col("n_bins_filled") >= 0.8 * n_bins
    return out.withColumns(
        {
            "monotone": F.coalesce(F.abs("spearman") >= MONOTONE_MIN, F.lit(False)),
            "odd": F.coalesce(F.col("odd_error") <= ODD_ERROR_MAX, F.lit(False)),
            "ambiguous": ~enough,
        }
    ).withColumn(
        "passed", enough & (F.col("scale") >= DEGENERATE) & F.col("monotone") & F.col("odd")
    ).drop("scale")


def measure_affine(dataset: DataFrame, symbol: str, x: str, y: str, min_rows: int = 20) -> DataFrame:
    spread = metrics.slope_spread(dataset, symbol, x, y, min_rows)
    return spread.withColumns(
        {
            "ambiguous": F.col("n_symbols") < 3,
            "passed": F.coalesce(
                (F.col("n_symbols") >= 3) & (F.col("slope_cv") <= SLOPE_CV_MAX) & (F.col("slope_mean") > 0),
                F.lit(False),
            ),
        }
    )


def measure_exponent(dataset: DataFrame, x: str, y: str) -> DataFrame:
    fit = metrics.log_log_fit(dataset, x, y)
    ambiguous = (F.col("n") < MIN_ROWS) | (F.col("r2") < LOG_R2_MIN)
    return fit.withColumn("ambiguous", ambiguous).withColumn(
        "passed", ~F.col("ambiguous") & F.col("exponent").between(*EXPONENT_RANGE)
    )


def measure_multiscale(dataset: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """Multiple regression; the solve is k by k on the driver, the sums are one aggregate."""
    spark = dataset.sparkSession
    fit = metrics.linear_fit(co_moments(dataset, [*xs, y]))
    coef = [float(c) for c in fit["coef"]]
    used = all(abs(c) > MULTI_SLOPE_MIN for c in coef)
    positive = all(c > 0 for c in coef)
    enough = fit["n"] >= MIN_ROWS and fit["r2"] is not None
    row = (
        int(fit["n"]),
        *coef,
        fit["intercept"],
        fit["r2"],
        used,
        positive,
        bool(enough and fit["r2"] >= MULTI_R2_MIN and used and positive),
    )
    schema = (
        "n long, "
        + ", ".join(f"coef{i + 1} double" for i in range(len(coef)))
        + ", intercept double, r2 double, uses_all boolean, all_positive boolean, passed boolean"
    )
    return spark.createDataFrame([row], schema)


def decay_grid(low: float = 0.01, high: float = 10.0, steps: int = 60) -> list[float]:
    """Log-spaced candidate decay rates or exponents."""
    return [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]


def decay_shape(form: str, t: Column, rate: float, eps: float = 1e-6) -> Column:
    """The curve of a form and rate, before its two constants."""
    return F.exp(t * F.lit(-float(rate))) if form == "exponential" else F.pow(t + eps, F.lit(-float(rate)))


def decay_fits(bins: DataFrame, grid: Sequence[float], eps: float = 1e-6) -> DataFrame:
    """``form, rate, r2, slope, intercept``: the regression of the bin means on each form at each rate."""
    shapes = F.array(
        *[
            F.struct(F.lit(form).alias("form"), F.lit(float(r)).alias("rate"), decay_shape(form, F.col("mean_x"), r, eps).alias("c"))
            for r in grid
            for form in ("exponential", "power")
        ]
    )
    return (
        bins.select("mean_x", "mean_y", F.explode(shapes).alias("s"))
        .groupBy("s.form", "s.rate")
        .agg(
            F.regr_r2("mean_y", "s.c").alias("r2"), F.regr_slope("mean_y", "s.c").alias("slope"),
            F.regr_intercept("mean_y", "s.c").alias("intercept"),
        )
    )


def measure_decay(bins: DataFrame, grid: Sequence[float], n_bins: int = 50, eps: float = 1e-6) -> DataFrame:
    """Does an exponential or a power decay explain the bin means better than a line?

    For a fixed rate the curve is linear in its two other constants, so every candidate is one
    regression; the best rate of each form is kept.
    """
    bins = cut_lineage(bins)
    fits = decay_fits(bins, grid, eps)
    best = fits.groupBy("form").agg(F.max(F.struct("r2", "rate")).alias("b"))
    wide = best.agg(
        F.max(F.when(F.col("form") == "exponential", F.col("b"))).alias("e"),
        F.max(F.when(F.col("form") == "power", F.col("b"))).alias("p"),
    )
    line = bins.agg(F.count(F.lit(1)).alias("n_bins_filled"), F.regr_r2("mean_y", "mean_x").alias("linear_r2"))
    out = wide.withColumn("l", line.select(F.struct("*")).scalar()).select(
        F.col("l.n_bins_filled").alias("n_bins_filled"),
        F.col("e.r2").alias("exponential_r2"),
        F.col("e.rate").alias("exponential_rate"),
        F.col("p.r2").alias("power_r2"),
        F.col("p.rate").alias("power_rate"),
        F.col("l.linear_r2").alias("linear_r2"),
    )
    top = F.greatest("exponential_r2", "power_r2")
    ambiguous = (F.col("n_bins_filled") < 0.6 * n_bins) | (top < DECAY_R2_MIN)
    return out.withColumns(
        {
            "chosen": F.when(F.col("exponential_r2") >= F.col("power_r2"), "exponential").otherwise("power"),
            "ambiguous": ambiguous,
            "passed": ~ambiguous & (top - F.col("linear_r2") >= DECAY_MARGIN_MIN),
        }
    )


def in_band(passed: Column, ambiguous: Column) -> Column:
    return passed & ~ambiguous
