"""Decision rules: CASE expressions over aggregated rows.

Each rule is a Column so that it can be applied to any table with the named inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ROWS = 1_000
MIN_SYMBOLS = 20
MIN_SCORABLE = 200
AGREEMENT_MIN = 0.995
EQUIVALENCE_RATIO = 0.9
VETO_LAWS = ("L1", "L2")
POSITIVE_CONTROL = "L1"
HARM_MARGIN = 0.05


def _case(*branches: tuple[Column, str], default: str) -> Column:
    out = None
    for condition, label in branches:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(default)


def label_economics(n_rows: Column, n_symbols: Column, low: Column, high: Column) -> Column:
    return _case(
        ((n_rows < MIN_ROWS) | (n_symbols < MIN_SYMBOLS), "too few"),
        (low > 0, "profit"),
        (high < 0, "loss"),
        default="undecided",
    )


def contract_economics(scorable: Column, total_net: Column, low: Column, high: Column) -> Column:
    return _case(
        (scorable < MIN_SCORABLE, "too few"),
        ((total_net > 0) & (low > 0), "profit"),
        (high < 0, "loss"),
        default="undecided",
    )


def paired_effect(low: Column, high: Column) -> Column:
    return _case((low > 0, "better"), (high < 0, "worse"), default="no effect")


def intervals_overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return ~((a_low > b_high) | (b_low > a_high))


def heterogeneity(groups: DataFrame, controls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Do symbol groups differ, and is it the data or the model?

    ``groups`` has ``by..., model ('primary'|'baseline'), grp, r2, lo, hi``; ``controls`` the
    same columns measured on permuted outcomes. Any control interval above zero withholds the
    verdict. A difference needs separated best and worst groups, the best above zero and the
    worst not; it lies in the data when the baseline separates the same best group.
    """
    alarms = controls.groupBy(*by).agg(F.count_if(F.col("lo") > 0).alias("violations"))
    cell = F.struct("r2", "grp", "lo", "hi")
    ends = groups.groupBy(*by, "model").agg(F.max(cell).alias("best"), F.min(cell).alias("worst"))
    apart = ~intervals_overlap(
        F.col("best.lo"), F.col("best.hi"), F.col("worst.lo"), F.col("worst.hi")
    )
    # With closed intervals all pairs overlap exactly when the highest low is under the lowest high.
    common = groups.groupBy(*by, "model").agg((F.max("lo") <= F.min("hi")).alias("all_overlap"))
    judged = ends.join(common, [*by, "model"]).withColumn("apart", apart)
    primary = judged.filter(F.col("model") == "primary").select(
        *by, F.col("best").alias("p_best"), F.col("worst").alias("p_worst"),
        F.col("apart").alias("p_apart"), "all_overlap",
    )
    baseline = judged.filter(F.col("model") == "baseline").select(
        *by, F.col("best.grp").alias("b_best"), F.col("apart").alias("b_apart")
    )
    yes = F.col("p_apart") & (F.col("p_best.lo") > 0) & (F.col("p_worst.lo") <= 0)
    out = primary.join(baseline, list(by), "left").join(alarms, list(by), "left")
    held = F.coalesce("violations", F.lit(0)) > 0
    return out.select(
        *by,
        F.col("p_best.grp").alias("best_group"),
        F.col("p_worst.grp").alias("worst_group"),
        _case((held, "withheld"), (yes, "yes"), (F.col("all_overlap"), "no"), default="unclear").alias(
            "heterogeneity"
        ),
        F.when(
            ~held & yes,
            F.when(F.col("b_apart") & (F.col("b_best") == F.col("p_best.grp")), "essence").otherwise(
                "model value"
            ),
        ).alias("nature"),
    )


def law_gate(laws: DataFrame) -> DataFrame:
    """``law, recovered`` rows to one verdict: enough laws, and not both veto laws lost."""
    counted = laws.agg(
        F.count(F.lit(1)).alias("n_laws"),
        F.count_if("recovered").alias("n_recovered"),
        F.count_if(F.col("law").isin(*VETO_LAWS) & ~F.col("recovered")).alias("veto_failed"),
    )
    return counted.withColumn(
        "verdict",
        _case(
            (F.col("n_recovered") <= 2, "stop"),
            (F.col("veto_failed") == len(VETO_LAWS), "hold"),
            default="proceed",
        ),
    )


def reference_gate_by_law(laws: DataFrame) -> DataFrame:
    """Grade each law against the interval of its reference ceiling.

    Columns: ``law, control_clean, eligible, ci_low, ci_high, score, score_baseline, score_direct``.
    """
    score = F.col("score")
    return laws.select(
        "law",
        _case(
            (~F.col("control_clean"), "untrusted"),
            (score.isNull(), "not distilled"),
            (~F.col("eligible"), "ineligible"),
            default="graded",
        ).alias("status"),
        F.coalesce(score >= F.col("ci_low"), F.lit(False)).alias("recovered"),
        F.coalesce(score > F.col("ci_high"), F.lit(False)).alias("exceeds_ceiling"),
        F.coalesce(F.col("score_baseline") > score, F.lit(False)).alias("no_added_value"),
        F.coalesce(F.col("score_direct") > score + HARM_MARGIN, F.lit(False)).alias("teacher_harmed"),
        "eligible",
        "control_clean",
        score,
    )


def reference_gate(laws: DataFrame) -> DataFrame:
    graded = reference_gate_by_law(laws)
    control = F.col("law") == POSITIVE_CONTROL
    counted = graded.agg(
        F.count_if(~control & (F.col("status") == "graded")).alias("eligible_laws"),
        F.count_if(~control & (F.col("status") == "graded") & F.col("recovered")).alias("recovered_laws"),
        F.coalesce(
            F.bool_and(
                F.when(
                    control,
                    F.col("eligible") & F.col("control_clean") & (F.col("recovered") | F.col("score").isNull()),
                )
            ),
            F.lit(False),
        ).alias("control_holds"),
    )
    eligible, recovered = F.col("eligible_laws"), F.col("recovered_laws")
    return counted.withColumn(
        "verdict",
        _case(
            (~F.col("control_holds"), "STOP"),
            (eligible == 0, "INSUFFICIENT_TARGETS"),
            (recovered == eligible, "PROCEED"),
            (recovered == 0, "STOP"),
            default="HOLD",
        ),
    )


def direct_versus_sampled(direct_in_band: Column, sampled_in_band: Column) -> Column:
    """Where a law is lost: measured on all rows against measured on the sampled rows."""
    return _case(
        (direct_in_band & sampled_in_band, "law holds, search method at fault"),
        (direct_in_band & ~sampled_in_band, "sampling distorts"),
        (~direct_in_band & ~sampled_in_band, "law absent here"),
        default="needs explanation",
    )


def seed_pass(
    gate_passed: Column, total_net: Column, scorable: Column, null_net: Column
) -> Column:
    beats = F.coalesce(total_net > null_net, F.lit(False))
    return F.coalesce(
        gate_passed & (total_net > 0) & (scorable >= MIN_SCORABLE) & beats, F.lit(False)
    )


def equivalence(candidate_r2: Column, reference_r2: Column) -> Column:
    return F.when(reference_r2.isNull(), "withheld").otherwise(
        _case((candidate_r2 >= EQUIVALENCE_RATIO * reference_r2, "equivalent"), default="worse")
    )


def prediction_check(
    misaligned: Column, control_diff: Column, same_min: Column, swapped_max: Column, tolerance: float = 1e-5
) -> Column:
    """Re-scored predictions pass when aligned, equal within tolerance, and told apart when swapped."""
    return (
        (misaligned == 0)
        & (control_diff <= tolerance)
        & F.coalesce(same_min >= AGREEMENT_MIN, F.lit(False))
        & F.coalesce(swapped_max < AGREEMENT_MIN, F.lit(False))
    )


def drift_signal(
    best_q_moved: Column,
    at_top_q: Column,
    scorable: Column,
    cost_share_before: Column,
    cost_share_now: Column,
    dominant_before: Column,
    dominant_now: Column,
    jump: float = 0.1,
) -> Column:
    """Structural drift between two periods of one contract, most severe first."""
    return _case(
        (
            (dominant_before == "NET_RECOVERY") & (dominant_now == "PERSISTENT_ADVERSE"),
            "cohort reversal",
        ),
        (at_top_q & (scorable <= MIN_SCORABLE), "threshold at extreme"),
        (cost_share_now - cost_share_before > jump, "cohort shift"),
        (best_q_moved, "threshold drift"),
        default="none",
    )
