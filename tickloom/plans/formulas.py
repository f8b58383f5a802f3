"""Formula tables: scoring many candidate expressions in one pass over the rows."""

from __future__ import annotations

from collections.abc import Mapping
from contextlib import contextmanager
from itertools import combinations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import finite
from tickloom.operators import metrics
from tickloom.operators.moments import weighted_correlations
from tickloom.operators.quantiles import grouped_quantiles
from tickloom.session import cut_lineage


def best_per_form(candidates: DataFrame, form: str, score: str, ident: str) -> DataFrame:
    """Keep the best-scoring candidate of each normal form; equal scores keep the lowest id."""
    window = Window.partitionBy(form).orderBy(F.col(score).desc_nulls_last(), F.col(ident).asc())
    return candidates.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def pareto_front(
    candidates: DataFrame, score: str, complexity: str, ident: str, keep: int = 12
) -> DataFrame:
    """The ``keep`` best scores, cheaper first on ties, listed by complexity."""
    best = candidates.orderBy(
        F.col(score).desc_nulls_last(), F.col(complexity).asc(), F.col(ident).asc()
    ).limit(keep)
    return best.orderBy(complexity, ident)


# --- scoring -----------------------------------------------------------------


@contextmanager
def lenient_arithmetic(spark: SparkSession):
    """Formulas come as text and may divide by zero: that row has no value, the job goes on.

    The arithmetic mode is fixed when an expression is analysed, so it is only set around that.
    """
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def evaluate(df: DataFrame, formulas: Mapping[str, str], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Add one column per formula that can be analysed; NaN and infinite values become NULL.

    Returns the frame and the ids of the formulas that could not be analysed.
    """
    good, bad = {}, []
    with lenient_arithmetic(df.sparkSession):
        for name, text in formulas.items():
            try:
                df.select(F.expr(text).cast("double")).schema  # noqa: B018 (analysis only)
                good[name] = finite(F.expr(text))
            except AnalysisException:
                bad.append(name)
        return df.select(*keep, *[c.alias(n) for n, c in good.items()]), bad


def score_formulas(df: DataFrame, formulas: Mapping[str, str], y: str, w: str) -> DataFrame:
    """Weighted R squared of every formula in one pass; NULL is the worst score."""
    valued, bad = evaluate(df, formulas, [y, w])
    names = [n for n in formulas if n not in bad]
    scores = valued.agg(
        *[metrics.weighted_r2(F.col(y), F.col(n), F.col(w)).alias(n) for n in names]
    )
    cells = [F.struct(F.lit(n).alias("formula_id"), F.col(n).alias("r2")) for n in names]
    cells += [F.struct(F.lit(n).alias("formula_id"), F.lit(None).cast("double").alias("r2")) for n in bad]
    return scores.select(F.inline(F.array(*cells)))


def response_curves(
    df: DataFrame,
    formulas: Mapping[str, str],
    *,
    sweep: str,
    others: list[str],
    points: int = 41,
) -> DataFrame:
    """Value and central-difference slope of each formula along ``sweep``, others at their median.

    The sweep runs between the 2nd and 98th percentile of the data.
    """
    df = cut_lineage(df.select(sweep, *others))
    ends = grouped_quantiles(df, [], sweep, {"lo": 0.02, "hi": 0.98}).select(F.struct("lo", "hi")).scalar()
    grid = df.sparkSession.range(points).select(F.col("id").alias("point"), ends.alias("_e"))
    for other in others:
        middle = grouped_quantiles(df, [], other, {"m": 0.5}).select("m").scalar()
        grid = grid.withColumn(other, middle)
    low, high = F.col("_e.lo"), F.col("_e.hi")
    step = (high - low) * 1e-4
    at = low + (high - low) * F.col("point") / (points - 1)
    offsets = F.array(*[F.struct(F.lit(s).alias("shift"), (at + s * step).alias("at")) for s in (-1, 0, 1)])
    moved = grid.withColumn("_step", step).select(
        "point", "_step", *others, F.inline(offsets)
    ).withColumn(sweep, F.col("at"))
    valued, bad = evaluate(moved, formulas, ["point", "_step", "shift", "at"])
    names = [n for n in formulas if n not in bad]
    long = valued.unpivot(["point", "_step", "shift", "at"], names, "formula_id", "value")

    def value(shift: int):
        return F.max(F.when(F.col("shift") == shift, F.col("value")))

    return long.groupBy("formula_id", "point").agg(
        F.max(F.when(F.col("shift") == 0, F.col("at"))).alias("at"),
        value(0).alias("value"),
        ((value(1) - value(-1)) / (2.0 * F.max("_step"))).alias("slope"),
    )


def slope_constancy(curves: DataFrame) -> DataFrame:
    """Mean slope and its coefficient of variation: nearly constant means nearly affine."""
    return curves.groupBy("formula_id").agg(
        F.count("slope").alias("points"),
        F.avg("slope").alias("slope_mean"),
        F.abs(F.try_divide(F.stddev_pop("slope"), F.avg("slope"))).alias("slope_cv"),
    )


# Name, number of inputs, formula, and its size as an expression tree.
TEMPLATES = (
    ("linear1", 1, "{0}", 1),
    ("neg1", 1, "-{0}", 3),
    ("abs1", 1, "abs({0})", 2),
    ("linear2", 2, "{0} + {1}", 3),
    ("diff2", 2, "{0} - {1}", 5),
    ("product2", 2, "{0} * {1}", 3),
    ("ratio2", 2, "{0} / (1 + abs({1}))", 8),
    ("sqrt_abs", 1, "sqrt(abs({0}))", 4),
    ("tanh1", 1, "tanh({0})", 2),
    ("linear3", 3, "{0} + {1} + {2}", 4),
    ("mixed3", 3, "{0} * {1} + {2}", 5),
    ("saturated2", 2, "tanh({0}) * {1}", 4),
)


def rank_inputs(df: DataFrame, inputs: list[str], y: str, w: str, top: int | None = None) -> DataFrame:
    """Inputs by absolute weighted correlation with the outcome, names breaking ties."""
    found = weighted_correlations(df, inputs, y, w)
    ranked = found.select("input", F.coalesce(F.abs("r"), F.lit(0.0)).alias("strength"))
    ordered = ranked.orderBy(F.col("strength").desc(), F.col("input").asc())
    return ordered.limit(top) if top else ordered


def template_search(
    df: DataFrame, inputs: list[str], y: str, w: str, top_inputs: int = 4, keep: int = 12
) -> DataFrame:
    """Fit slope and intercept of every template over the strongest inputs, keep the best.

    All candidates are scored in one scan: with the two constants fitted, weighted R squared is
    the squared weighted correlation.
    """
    df = cut_lineage(df.select(*inputs, y, w))
    strongest = [r["input"] for r in rank_inputs(df, inputs, y, w, top_inputs).collect()]
    texts, sizes = {}, {}
    for name, arity, form, size in TEMPLATES:
        for combo in combinations(strongest, arity):
            text = form.format(*combo)
            texts[text] = text
            sizes[text] = (name, size)
    numbered = {f"c{i}": t for i, t in enumerate(texts)}
    valued, _ = evaluate(df, numbered, [y, w])
    found = weighted_correlations(valued, list(numbered), y, w)
    scored = found.select(F.col("input").alias("candidate"), (F.col("r") * F.col("r")).alias("score"))
    labels = df.sparkSession.createDataFrame(
        [(c, t, sizes[t][0], sizes[t][1]) for c, t in numbered.items()],
        "candidate string, formula string, template string, complexity int",
    )
    known = scored.filter(F.col("score").isNotNull()).join(labels, "candidate").drop("candidate")
    return pareto_front(best_per_form(known, "formula", "score", "formula"), "score", "complexity", "formula", keep)


def score_linear(df: DataFrame, array: str, weights: list[float], intercept: float, out: str = "score") -> DataFrame:
    """Apply a stored linear model to a fixed-width input array."""
    products = F.zip_with(F.array(*[F.lit(float(b)) for b in weights]), F.col(array), lambda b, x: b * x)
    total = F.aggregate(products, F.lit(0.0), lambda a, p: a + p)
    return df.withColumn(out, total + F.lit(float(intercept)))
