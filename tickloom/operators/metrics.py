"""Fit quality, calibration, regression and correlation from grouped sums."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.numeric import ratio, root
from tickloom.operators.moments import Moments, co_moments
from tickloom.operators.positions import even_pieces, range_piece, sorted_running_total, tile
from tickloom.operators.quantiles import grouped_quantiles
from tickloom.session import broadcast_if_small, cut_lineage


# --- R squared ---------------------------------------------------------------


def weighted_r2(y: Column, pred: Column, w: Column) -> Column:
    """Aggregate: weighted R squared; NULL under two rows or without variance."""
    known = y.isNotNull() & pred.isNotNull() & w.isNotNull()

    def total(value: Column) -> Column:
        return F.sum(F.when(known, value))

    sw, swy, swyy = total(w), total(w * y), total(w * y * y)
    sse = total(w * (y - pred) * (y - pred))
    sst = swyy - ratio(swy * swy, sw)
    return F.when((F.count_if(known) >= 2) & (sst > 0), 1.0 - ratio(sse, sst))


def weighted_corr(x: Column, y: Column, w: Column, min_rows: int = 10) -> Column:
    """Aggregate: weighted correlation; NULL under ``min_rows`` rows or without variance."""
    known = x.isNotNull() & y.isNotNull() & w.isNotNull()

    def mean(value: Column) -> Column:
        return ratio(F.sum(F.when(known, value)), F.sum(F.when(known, w)))

    mx, my = mean(w * x), mean(w * y)
    cov = mean(w * x * y) - mx * my
    xx, yy = mean(w * x * x), mean(w * y * y)
    vx, vy = xx - mx * mx, yy - my * my
    # What rounding leaves of a constant column is no variance; the bound follows the column's unit.
    varies = (vx > 1e-13 * xx) & (vy > 1e-13 * yy)
    return F.when((F.count_if(known) >= min_rows) & varies, ratio(cov, root(vx) * root(vy)))


def symbol_statistics(
    df: DataFrame, by: Sequence[str], y: str = "y", preds: Mapping[str, str] | None = None
) -> DataFrame:
    """Sufficient statistics ``n, sy, syy`` and one ``sse`` column per prediction."""
    preds = preds or {"sse": "pred"}
    out = F.col(y)
    return df.groupBy(*by).agg(
        F.count(out).alias("n"),
        F.sum(out).alias("sy"),
        F.sum(out * out).alias("syy"),
        *[F.sum((out - F.col(p)) * (out - F.col(p))).alias(name) for name, p in preds.items()],
    )


def pooled_r2(stats: DataFrame, by: Sequence[str], sse: Sequence[str] = ("sse",)) -> DataFrame:
    """R squared of pooled symbols, one column ``r2_<sse>`` per error column."""
    sums = stats.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy", *sse)])
    total = F.col("syy") - ratio(F.col("sy") * F.col("sy"), F.col("n"))
    return sums.select(
        *by, "n", *[F.when(total > 0, 1.0 - ratio(F.col(e), total)).alias(f"r2_{e}") for e in sse]
    )


def r2_by_groups(
    stats: DataFrame, first: str, second: str, sse: str = "sse", min_symbols: int = 20
) -> DataFrame:
    """R squared over all symbols, each group of either kind, and their cells in one pass."""
    sums = stats.groupingSets([[], [first], [second], [first, second]], first, second).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n_symbols"),
        *[F.sum(c).alias(c) for c in ("n", "sy", "syy", sse)],
    )
    total = F.col("syy") - ratio(F.col("sy") * F.col("sy"), F.col("n"))
    return sums.select(
        "level",
        first,
        second,
        "n_symbols",
        "n",
        F.when(total > 0, 1.0 - ratio(F.col(sse), total)).alias("r2"),
        (F.col("n_symbols") >= min_symbols).alias("interpretable"),
    )


def variation_shares(stats: DataFrame, by: Sequence[str], symbol: str) -> DataFrame:
    """Each symbol's share of rows and of the squared deviation from the overall mean."""
    totals = stats.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum("sy").alias("_sy"))
    joined = stats.join(totals, list(by))
    mean = F.col("_sy") / F.col("_n")
    part = F.col("syy") - 2 * mean * F.col("sy") + F.col("n") * mean * mean
    parts = joined.withColumn("part", part)
    sums = parts.groupBy(*by).agg(F.sum("part").alias("_part"))
    return parts.join(sums, list(by)).select(
        *by,
        symbol,
        *[c for c in stats.columns if c not in (*by, symbol)],
        ratio(F.col("part"), F.col("_part")).alias("variation_share"),
        ratio(F.col("n"), F.col("_n")).alias("row_share"),
    )


def top_variation(shares: DataFrame, by: Sequence[str], symbol: str, k: int) -> DataFrame:
    """The ``k`` symbols with the largest variation share, with their ``place``."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.col("variation_share").desc(), F.col(symbol).asc())
    return shares.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def concentration(shares: DataFrame, by: Sequence[str], symbol: str, ks: Sequence[int]) -> DataFrame:
    """Cumulative variation share of the top symbols."""
    top = top_variation(shares, by, symbol, max(ks))
    return top.groupBy(*by).agg(
        *[F.sum(F.when(F.col("place") <= k, F.col("variation_share"))).alias(f"top{k}") for k in ks]
    )


def r2_without_top(
    shares: DataFrame, by: Sequence[str], symbol: str, ks: Sequence[int], sse: str = "sse"
) -> DataFrame:
    """Pooled R squared after leaving out the top symbols: totals minus the top rows."""
    top = top_variation(shares, by, symbol, max(ks))
    columns = ("n", "sy", "syy", sse)
    totals = shares.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])
    removed = top.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("place") <= k, F.col(c))), F.lit(0)).alias(f"{c}_{k}")
            for k in ks
            for c in columns
        ]
    )
    joined = totals.join(removed, list(by))
    out = []
    for k in ks:
        n, sy, syy, e = (F.col(c) - F.col(f"{c}_{k}") for c in columns)
        total = syy - ratio(sy * sy, n)
        out.append(F.when(total > 0, 1.0 - ratio(e, total)).alias(f"r2_without_{k}"))
    return joined.select(*by, *out)


# --- calibration -------------------------------------------------------------

DECILES = {f"e{i}": i / 10 for i in range(11)}
TOPS = {"t99": 0.99, "t999": 0.999}


def calibration_table(df: DataFrame, by: Sequence[str], pred: str, y: str) -> DataFrame:
    """Deciles of the prediction (last one closed) and its top 1 % and 0.1 %."""
    known = df.select(*by, F.col(pred).alias("p"), F.col(y).alias("y")).na.drop(subset=["p", "y"])
    # One row per group: counted, then sent to the facts, which stay where they are.
    edges = broadcast_if_small(cut_lineage(grouped_quantiles(known, by, "p", {**DECILES, **TOPS})))
    joined = known.join(edges, list(by))
    p = F.col("p")
    decile = reduce(lambda a, b: a + b, [(p >= F.col(f"e{i}")).cast("int") for i in range(1, 10)]) + 1
    labels = F.array_compact(
        F.array(
            F.concat(F.lit("D"), decile.cast("string")),
            F.when(p >= F.col("t99"), "top1%"),
            F.when(p >= F.col("t999"), "top0.1%"),
        )
    )
    return (
        joined.select(*by, F.explode(labels).alias("bin"), "p", "y")
        .groupBy(*by, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("p").alias("lowest"),
            F.max("p").alias("highest"),
            F.avg("p").alias("mean_pred"),
            F.avg("y").alias("mean_y"),
            F.avg((F.col("y") > 0).cast("double")).alias("pos_share"),
        )
    )


def worst_calibration_gap(table: DataFrame, by: Sequence[str], limit: float = 0.25) -> DataFrame:
    deciles = table.filter(F.col("bin").startswith("D"))
    gap = F.max(F.abs(F.col("mean_pred") - F.col("mean_y")))
    return deciles.groupBy(*by).agg(gap.alias("max_abs_gap")).withColumn(
        "passed", F.col("max_abs_gap") <= limit
    )


def top_decile_outcome(df: DataFrame, by: Sequence[str], pred: str, outcome: str) -> DataFrame:
    """Mean outcome where the prediction is in its top decile; easy fills should lose."""
    cuts = broadcast_if_small(cut_lineage(grouped_quantiles(df, by, pred, {"_cut": 0.9})))
    top = df.join(cuts, list(by)).filter(F.col(pred) >= F.col("_cut"))
    return top.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("top_decile_mean")
    ).withColumn("passed", F.col("top_decile_mean") < 0)


def beats_constant(df: DataFrame, by: Sequence[str], pred: str, y: str, limit: float = 0.05) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(pred, y).alias("correlation")).withColumn(
        "passed", F.coalesce(F.col("correlation") > limit, F.lit(False))
    )


def binned_means(
    df: DataFrame, pred: str, y: str, w: str, tie: Sequence[str], bins: int = 20
) -> DataFrame:
    """Equal-count bins along the prediction with weighted means of outcome and prediction.

    Ranges of the order are summed; only the rows of ranges in which a bin ends are put in order.
    """
    # Read for the cuts, the sums and the bins' ends: only what they need is kept.
    known = cut_lineage(df.select(*dict.fromkeys([pred, y, w, *tie])).na.drop(subset=[pred, y, w]))
    order = [F.col(pred), *[F.col(t) for t in tie]]
    # A row's range costs more than its writing, so it is found once.
    ranged = cut_lineage(known.withColumn("_range", range_piece(known, order, even_pieces(df))))
    weight = F.col(w)
    sums = {"n": F.count(F.lit(1)), "swy": F.sum(weight * F.col(y)), "swp": F.sum(weight * F.col(pred)), "sw": F.sum(weight)}
    ranges = cut_lineage(ranged.groupBy("_range").agg(*[c.alias(n) for n, c in sums.items()]))
    # One row per range.
    upto, whole = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    placed = ranges.withColumns({"_before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "_n": F.sum("n").over(whole)})
    first = tile(F.col("_before") + 1, F.col("_n"), bins)
    placed = cut_lineage(placed.withColumns({"bin": first, "_last": tile(F.col("_before") + F.col("n"), F.col("_n"), bins)}))
    inside = Window.partitionBy("_range").orderBy(*order)
    # At most one range for each end of a bin.
    met = placed.filter(F.col("bin") != F.col("_last")).select("_range", "_before", "_n")
    cut = (
        ranged.join(F.broadcast(met), "_range")
        .withColumn("bin", tile(F.row_number().over(inside) + F.col("_before"), F.col("_n"), bins))
        .groupBy("bin").agg(*[c.alias(n) for n, c in sums.items()])
    )
    parts = placed.filter(F.col("bin") == F.col("_last")).select("bin", *sums).unionByName(cut)
    return parts.groupBy("bin").agg(
        ratio(F.sum("swy"), F.sum("sw")).alias("mean_y"),
        ratio(F.sum("swp"), F.sum("sw")).alias("mean_pred"),
        F.sum("sw").alias("weight"),
        F.sum("n").alias("n"),
    )


def binned_r2(means: DataFrame) -> DataFrame:
    return means.agg(
        weighted_r2(F.col("mean_y"), F.col("mean_pred"), F.col("weight")).alias("binned_r2")
    )


def conditional_means(
    df: DataFrame, x: str, y: str, low: Column, high: Column, bins: int, min_count: int
) -> DataFrame:
    """Mean of ``y`` in equal-width bins of ``x``; outside values fall in the edge bins."""
    place = F.floor((F.col(x) - low) / (high - low) * bins)
    index = F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("bigint")
    return (
        df.withColumn("bin", index)
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))
        .filter(F.col("n") >= min_count)
    )


# --- correlation and regression ----------------------------------------------


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """``value, out``: rank of each distinct value, equal values sharing the mean rank.

    Works on value counts, so equal values never meet in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = sorted_running_total(counts, [F.col(value)], "_c", "_upto")
    return ranked.select(value, (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(out))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ties over the rows where both are known."""
    rows = cut_lineage(df.select(x, y).na.drop())
    pairs = rows.groupBy(x, y).agg(F.count(F.lit(1)).alias("_n"))
    rx, ry = average_ranks(rows, x, "_rx"), average_ranks(rows, y, "_ry")
    ranked = pairs.join(rx, x).join(ry, y)
    n = F.col("_n").cast("double")
    return ranked.agg(weighted_corr(F.col("_rx"), F.col("_ry"), n, min_rows=1).alias("spearman"))


def slope_spread(
    df: DataFrame, symbol: str, x: str, y: str, min_rows: int = 20
) -> DataFrame:
    """Per-symbol slopes reduced to their mean, population spread and coefficient of variation."""
    slopes = (
        df.na.drop(subset=[x, y])
        .groupBy(symbol)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_slope(y, x).alias("slope"),
            F.stddev_pop(x).alias("sx"),
        )
        .filter((F.col("n") >= min_rows) & (F.col("sx") >= 1e-12) & F.col("slope").isNotNull())
    )
    return slopes.agg(
        F.count(F.lit(1)).alias("n_symbols"),
        F.avg("slope").alias("slope_mean"),
        F.stddev_pop("slope").alias("slope_std"),
    ).withColumn("slope_cv", F.abs(ratio(F.col("slope_std"), F.col("slope_mean"))))


def log_log_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Exponent, intercept and R squared of ``|y| ~ |x|`` on log scales; zeros are left out."""
    ax, ay = F.abs(F.col(x)), F.abs(F.col(y))
    logs = df.filter((ax > 0) & (ay > 0)).select(F.ln(ax).alias("lx"), F.ln(ay).alias("ly"))
    return logs.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("ly", "lx").alias("exponent"),
        F.regr_intercept("ly", "lx").alias("intercept"),
        F.regr_r2("ly", "lx").alias("r2"),
    )


def linear_fit(moments: Moments, ridge: float = 0.0, standardise: bool = False) -> dict:
    """Solve the k by k system of ``co_moments`` over ``[features, outcome]`` on the driver."""
    mean, cov = moments.mean, moments.cov
    k = len(mean) - 1
    cxx, cxy = cov[:k, :k], cov[:k, k]
    scale = np.sqrt(np.diag(cxx)) if standardise else np.ones(k)
    scale = np.where(scale > 0, scale, 1.0)
    a = cxx / np.outer(scale, scale) + ridge * np.eye(k)
    b = cxy / scale
    beta = np.linalg.solve(a, b) if ridge else np.linalg.lstsq(a, b, rcond=None)[0]
    coef = beta / scale
    intercept = mean[k] - coef @ mean[:k]
    syy = cov[k, k]
    resid = syy - 2 * coef @ cxy + coef @ cxx @ coef
    return {
        "n": moments.n,
        "coef": coef,
        "intercept": float(intercept),
        "r2": float(1 - resid / syy) if syy > 0 else None,
    }


def demeaned(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Subtract each column's group mean. Means are aggregated and joined, so that a large
    group stays spread over tasks."""
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return (
        df.join(means, list(by))
        .withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns})
        .drop(*[f"_m_{c}" for c in columns])
    )


def covariance_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample covariances as a table ``a, b, cov, mean_a`` of ``k (k + 1) / 2`` rows."""
    moments = co_moments(df, columns)
    cov = moments.sample_cov
    rows = [
        (columns[i], columns[j], float(cov[i, j]), float(moments.mean[i])) for i in range(len(columns)) for j in range(i, len(columns))
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, cov double, mean_a double")


def with_mahalanobis(df: DataFrame, columns: Sequence[str], mean: np.ndarray, cov: np.ndarray, out: str = "distance") -> DataFrame:
    """Distance of each row from ``mean``; NULL where a column is. The pseudo-inverse copes with columns that copy each other.

    The matrix is ``k`` by ``k`` and goes to the tasks as it is; only ``columns`` are turned into numbers there.
    """
    inverse = np.linalg.pinv(np.atleast_2d(cov), hermitian=True)
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in places]) - mean
            square = np.einsum("ij,jk,ik->i", centred, inverse, centred, optimize=True)
            distance = pa.array(np.sqrt(np.maximum(square, 0.0)), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, distance], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def column_moments(df: DataFrame, array: str, width: int, tolerance: float = 1e-9) -> DataFrame:
    """Mean and population spread of each place of a fixed-width array; a spread of nearly
    zero counts as one, so that scaling leaves constants alone."""
    wide = df.agg(
        *[F.avg(F.element_at(array, i + 1)).alias(f"m{i}") for i in range(width)],
        *[F.var_pop(F.element_at(array, i + 1)).alias(f"v{i}") for i in range(width)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("place"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var"))
            for i in range(width)
        ]
    )
    flat = wide.select(F.inline(entries))
    constant = F.col("var") <= tolerance * (1.0 + F.col("mean") * F.col("mean"))
    return flat.select("place", "mean", F.when(constant, 1.0).otherwise(F.sqrt("var")).alias("scale"))
