"""Reference models: fitted on one set of symbols, scored on another.

Inputs are clamped to the range seen in fitting, so that no model answers where it saw nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import clip, ratio
from tickloom.operators import metrics
from tickloom.operators.filters import domain_of
from tickloom.operators.moments import co_moments
from tickloom.operators.quantiles import grouped_quantiles
from tickloom.operators.sampling import fold_assignments
from tickloom.plans.laws import MIN_ROWS, decay_fits, decay_shape, log_bins
from tickloom.session import cut_lineage


def linear(fit: DataFrame, score: DataFrame, x: str, y: str, out: str = "pred") -> DataFrame:
    line = fit.na.drop(subset=[x, y]).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.min(x).alias("lo"),
        F.max(x).alias("hi"),
    )
    at = clip(F.col(x), F.col("_m.lo"), F.col("_m.hi"))
    return (
        score.withColumn("_m", line.select(F.struct("*")).scalar())
        .withColumn(out, F.col("_m.slope") * at + F.col("_m.intercept"))
        .drop("_m")
    )


def power(fit: DataFrame, score: DataFrame, x: str, y: str, out: str = "pred") -> DataFrame:
    """``sign * exp(a ln|x| + b)``; the sign follows ``x`` or opposes it, whichever fits more rows."""
    ax, ay = F.abs(F.col(x)), F.abs(F.col(y))
    used = fit.filter((ax > 0) & (ay > 0)).select(
        F.ln(ax).alias("lx"), F.ln(ay).alias("ly"), ax.alias("ax"),
        (F.signum(x) == F.signum(y)).cast("double").alias("agree"),
    )
    curve = used.agg(
        F.regr_slope("ly", "lx").alias("slope"),
        F.regr_intercept("ly", "lx").alias("intercept"),
        F.when(F.avg("agree") >= 0.5, 1.0).otherwise(-1.0).alias("sign"),
        F.min("ax").alias("lo"),
        F.max("ax").alias("hi"),
    )
    size = clip(ax, F.col("_m.lo"), F.col("_m.hi"))
    value = F.col("_m.sign") * F.signum(x) * F.exp(F.col("_m.slope") * F.ln(size) + F.col("_m.intercept"))
    return (
        score.withColumn("_m", curve.select(F.struct("*")).scalar())
        .withColumn(out, F.when(F.col(x) != 0, value))
        .drop("_m")
    )


def fixed_effects(
    fit: DataFrame, score: DataFrame, symbol: str, xs: Sequence[str], y: str, out: str = "pred"
) -> DataFrame:
    """Slopes from deviations within symbols; a new symbol is centred on its own input means."""
    known = fit.na.drop(subset=[*xs, y])
    within = metrics.demeaned(known.select(symbol, *xs, y), [symbol], [*xs, y])
    coef = metrics.linear_fit(co_moments(within, [*xs, y]))["coef"]
    bounds = domain_of(within, xs).select(F.struct("*")).scalar()
    mean_y = known.agg(F.avg(y).alias("m")).scalar()
    means = score.groupBy(symbol).agg(*[F.avg(x).alias(f"_m_{x}") for x in xs])
    staged = score.join(means, symbol).withColumns({"_d": bounds, "_mean_y": mean_y})
    total = F.col("_mean_y")
    for b, x in zip(coef, xs):
        total = total + float(b) * clip(
            F.col(x) - F.col(f"_m_{x}"), F.col(f"_d.lo_{x}"), F.col(f"_d.hi_{x}")
        )
    return staged.withColumn(out, total).drop("_d", "_mean_y", *[f"_m_{x}" for x in xs])


def repeated_kfold(
    df: DataFrame, symbol: str, x: str, y: str, *, folds: int = 5, repeats: int = 20, seed: int | str = 0
) -> DataFrame:
    """Held-out R squared of a line per repeat, from per-symbol sums alone.

    A training set is everything minus one fold, so its sums are a difference, and the error of
    a line on the held-out fold is a polynomial of that fold's sums: rows are read once for any
    number of repeats.
    """
    px, py = F.col(x), F.col(y)
    sums = ("n", "sx", "sy", "sxx", "sxy", "syy")
    stats = (
        df.na.drop(subset=[x, y])
        .groupBy(symbol)
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum(px).alias("sx"),
            F.sum(py).alias("sy"),
            F.sum(px * px).alias("sxx"),
            F.sum(px * py).alias("sxy"),
            F.sum(py * py).alias("syy"),
        )
    )
    dealt = fold_assignments(stats, symbol, folds=folds, repeats=repeats, seed=seed)
    held = dealt.join(stats, symbol).groupBy("rep", "fold").agg(*[F.sum(c).alias(c) for c in sums])
    totals = held.groupBy("rep").agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    joined = held.join(totals, "rep")
    n, sx, sy, sxx, sxy = (F.col(f"t_{c}") - F.col(c) for c in sums[:5])
    slope = ratio(n * sxy - sx * sy, n * sxx - sx * sx)
    fitted = joined.withColumn("b", slope).withColumn("a", ratio(sy - F.col("b") * sx, n))
    a, b = F.col("a"), F.col("b")
    error = (
        F.col("syy") - 2 * a * F.col("sy") - 2 * b * F.col("sxy")
        + F.col("n") * a * a + 2 * a * b * F.col("sx") + b * b * F.col("sxx")
    )
    return (
        fitted.groupBy("rep")
        .agg(F.sum(error).alias("sse"), *[F.sum(c).alias(c) for c in ("n", "sy", "syy")])
        .select(
            "rep",
            (1.0 - ratio(F.col("sse"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))).alias("r2"),
        )
    )


def ridge_path(
    fit: DataFrame,
    select: DataFrame,
    xs: Sequence[str],
    y: str,
    w: str,
    alphas: Sequence[float] = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0),
) -> tuple[DataFrame, dict[float, dict]]:
    """Weighted ridge fits of one set of co-moments, all scored on ``select`` in one pass.

    Returns ``alpha, r2`` rows and the fitted models by alpha.
    """
    sums = co_moments(fit, [*xs, y], w)
    models = {a: metrics.linear_fit(sums, ridge=a, standardise=True) for a in alphas}
    scores = select.na.drop(subset=[*xs, y, w]).agg(
        *[
            metrics.weighted_r2(F.col(y), prediction(models[a], xs), F.col(w)).alias(f"a{i}")
            for i, a in enumerate(alphas)
        ]
    )
    cells = [F.struct(F.lit(float(a)).alias("alpha"), F.col(f"a{i}").alias("r2")) for i, a in enumerate(alphas)]
    return scores.select(F.inline(F.array(*cells))), models


def prediction(model: dict, xs: Sequence[str]):
    total = F.lit(model["intercept"])
    for b, x in zip(model["coef"], xs):
        total = total + float(b) * F.col(x)
    return total


def _isotonic(values: list[float], weights: list[float]) -> list[float]:
    """Nearest non-decreasing values: neighbours that fall are pooled until none do."""
    pools: list[list[float]] = []  # weighted sum, weight, members
    for value, weight in zip(values, weights):
        pools.append([value * weight, weight, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] > pools[-1][0] * pools[-2][1]:
            total, heavy, many = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + heavy, pools[-1][2] + many]
    return [total / weight for total, weight, many in pools for _ in range(int(many))]


def odd_and_monotone(counts: dict[int, float], means: dict[int, float], bins: int) -> dict[int, float]:
    """Bin means made odd, by pooling each bin with minus its mirror, and then monotone, in the direction they have."""
    weight = {b: counts.get(b, 0) + counts.get(bins - 1 - b, 0) for b in range(bins)}
    held = {b: counts.get(b, 0) * means.get(b, 0.0) - counts.get(bins - 1 - b, 0) * means.get(bins - 1 - b, 0.0) for b in range(bins)}
    places = [b for b in range(bins) if weight[b]]
    values = [held[b] / weight[b] for b in places]
    rises = sum(v * (b - (bins - 1) / 2) for b, v in zip(places, values)) >= 0
    sign = 1.0 if rises else -1.0
    pooled = _isotonic([sign * v for v in values], [weight[b] for b in places])
    return {b: sign * v for b, v in zip(places, pooled)}


def step_curve(
    fit: DataFrame, score: DataFrame, x: str, y: str, out: str = "pred", *, bins: int = 40, min_count: int = 5, odd: bool = False
) -> DataFrame:
    """Mean outcome of the bin of ``x``: equal bins between plus and minus the 95th percentile of ``|x|`` in ``fit``.

    Values outside fall into the edge bins. With ``odd`` the means are first made odd and monotone. NULL where ``x`` is
    missing or its bin had fewer than ``min_count`` rows; all NULL where ``fit`` has too few rows or only zeros.
    """
    known = cut_lineage(fit.na.drop(subset=[x, y]).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")))
    reach = grouped_quantiles(known.select(F.abs("_x").alias("_a")), [], "_a", {"reach": 0.95}).first()
    if reach is None or not reach["reach"] or known.count() < MIN_ROWS:
        return score.withColumn(out, F.lit(None).cast("double"))
    width = float(reach["reach"])
    # At most ``bins`` rows.
    means = metrics.conditional_means(known, "_x", "_y", F.lit(-width), F.lit(width), bins, min_count).collect()
    curve = {r["bin"]: r["mean_y"] for r in means}
    if odd:
        curve = odd_and_monotone({r["bin"]: r["n"] for r in means}, curve, bins)
    at = F.floor((F.col(x) + width) / (2 * width) * bins)
    place = F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("int")
    steps = F.array(*[F.lit(curve.get(b)).cast("double") for b in range(bins)])
    return score.withColumn(out, F.when(F.col(x).isNotNull(), F.get(steps, place)))


def decay(
    fit: DataFrame, score: DataFrame, x: str, y: str, grid: Sequence[float], out: str = "pred", *, bins: int = 50, min_count: int = 5
) -> DataFrame:
    """``c0 + c1 * exp(-r x)`` or ``c0 + c1 * (x + 1e-6)^-r``, whichever explains the log-spaced bin means of ``fit`` better.

    The rate is the best of ``grid``; the two constants are its regression. Inputs are clamped to the 2nd to 98th
    percentile of ``fit``, so that a power never runs away near zero. NULL for ``x`` that is missing or not above
    zero; all NULL where too few bins are filled.
    """
    dataset = cut_lineage(fit.na.drop(subset=[x, y]).filter(F.col(x) > 0).select(x, y, F.lit(True).alias("mask")))
    domain = grouped_quantiles(dataset, [], x, {"lo": 0.02, "hi": 0.98}).first()
    nothing = score.withColumn(out, F.lit(None).cast("double"))
    if domain is None or not domain["hi"] > domain["lo"] or dataset.count() < MIN_ROWS:
        return nothing
    points = log_bins(dataset, x, y, bins, min_count).select("mean_x", "mean_y").collect()  # at most ``bins`` rows
    if len(points) < 0.6 * bins:
        return nothing
    table = fit.sparkSession.createDataFrame(points)
    best = decay_fits(table, grid).orderBy(F.desc("r2"), F.asc("form"), F.desc("rate")).first()
    at = clip(F.col(x), F.lit(domain["lo"]), F.lit(domain["hi"]))
    shape = decay_shape(best["form"], at, best["rate"])
    return score.withColumn(out, F.when(F.col(x) > 0, best["intercept"] + best["slope"] * shape))
