"""Plans: denominators, verdict scenarios, laws with known answers, bootstraps."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bootstrap as boot
from tickloom.operators import metrics
from tickloom.plans import formulas, labels, laws, ledger, references, selection, verdicts


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_censored_decisions_leave_the_denominator(spark):
    data = [("c", "FILLED", 10.0, "NET_RECOVERY")] * 3 + [("c", "UNFILLED", None, None), ("c", "CENSORED", None, None)]
    got = ledger.contract_summary(rows(spark, data, "contract_id string, status string, net_bps double, cohort string")).first()
    assert (got.decisions, got.scorable, got.fills, got.censored) == (5, 4, 3, 1)
    assert got.bps_per_decision == 7.5 and got.positive and got.cohort_NET_RECOVERY == 3


def test_small_profitable_contracts_do_not_rank(spark):
    def many(cid, n, net):
        return [(cid, "FILLED", net, "NET_RECOVERY")] * n

    data = many("tiny", 20, 900.0) + many("big", 250, 1.0) + many("also", 250, 1.0)
    summary = ledger.contract_summary(rows(spark, data, "contract_id string, status string, net_bps double, cohort string"))
    ranked = ledger.rank_contracts(summary).orderBy("place").collect()
    assert [r.contract_id for r in ranked] == ["also", "big"]


def test_ledger_differences_are_empty_for_equal_ledgers(spark):
    data = [("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 2.0), ("b", 2, 3.0)]
    df = rows(spark, data, "contract_id string, symbol long, net double")
    assert ledger.ledger_differences(df, "a", "b", ["symbol", "net"]).count() == 0
    assert ledger.ledger_differences(df.limit(3), "a", "b", ["symbol", "net"]).count() == 1


def test_path_label_is_net_of_fee_and_masked_at_the_end(spark):
    data = [("s", i + 1, i * 500_000, 9990.0 + i, 10000.0 + i) for i in range(100)]
    df = rows(spark, data, "symbol string, seq long, t long, bid1 double, ask1 double")
    got = labels.path_label(df, ["symbol"], "t", "seq").orderBy("seq").collect()
    raw = (9990.0 + 60) / 10000.0
    assert math.isclose(got[0].raw_net_bps, (raw - 1) * 1e4 - 23, rel_tol=1e-9)
    assert got[39].mask and not got[40].mask and got[40].y_path is None


def stats_of(spark, data):
    return metrics.symbol_statistics(spark.createDataFrame(data), ["symbol"], "y", {"sse_a": "a", "sse_b": "b"})


def test_paired_bootstrap_of_equal_predictions_is_exactly_zero(spark):
    rng = np.random.default_rng(0)
    n = 600
    data = pd.DataFrame({"symbol": np.arange(n) % 30, "y": rng.normal(size=n), "a": rng.normal(size=n)})
    data["b"] = data.a
    stat = stats_of(spark, data)
    counts = boot.draw_counts(stat.select("symbol"), [], "symbol", reps=50, seed=1)
    assert counts.groupBy("rep").agg(F.sum("times").alias("k")).filter("k != 30").count() == 0
    reps = boot.replicate_sums(counts, stat, ["symbol"], [], ["n", "sy", "syy", "sse_a", "sse_b"])
    ci = boot.interval(reps, [], boot.r2_of_sums(sse="sse_b") - boot.r2_of_sums(sse="sse_a"), {"lo": 0.025, "hi": 0.975})
    assert tuple(ci.select("lo", "hi").first()) == (0.0, 0.0)


def test_kfold_from_sums_matches_rows(spark):
    rng = np.random.default_rng(2)
    n = 800
    data = pd.DataFrame({"symbol": np.arange(n) % 20, "x": rng.normal(size=n)})
    data["y"] = 2 * data.x + rng.normal(size=n)
    df = spark.createDataFrame(data)
    got = {r.rep: r.r2 for r in references.repeated_kfold(df, "symbol", "x", "y", folds=4, repeats=2, seed=3).collect()}
    from tickloom.operators.sampling import fold_assignments

    folds = fold_assignments(df.select("symbol").distinct(), "symbol", folds=4, repeats=2, seed=3).toPandas()
    for rep, part in folds.groupby("rep"):
        fold = data.symbol.map(part.set_index("symbol").fold)
        pred = np.empty(n)
        for f in range(4):
            b, a = np.polyfit(data.x[fold != f], data.y[fold != f], 1)
            pred[fold == f] = a + b * data.x[fold == f]
        want = 1 - ((data.y - pred) ** 2).sum() / ((data.y - data.y.mean()) ** 2).sum()
        assert np.isclose(got[rep], want)


GROUP = "axis string, model string, grp string, r2 double, lo double, hi double"


@pytest.mark.parametrize(
    "primary,baseline,control,expected",
    [
        ({"big": (0.3, 0.2, 0.4), "small": (-0.1, -0.2, 0.0)}, {"big": (0.2, 0.15, 0.3), "small": (0.0, -0.1, 0.05)}, -0.1, ("yes", "essence")),
        ({"big": (0.3, 0.2, 0.4), "small": (-0.1, -0.2, 0.0)}, {"big": (0.1, 0.0, 0.2), "small": (0.1, 0.0, 0.2)}, -0.1, ("yes", "model value")),
        ({"big": (0.1, 0.0, 0.2), "small": (0.1, 0.05, 0.3)}, {"big": (0.1, 0.0, 0.2), "small": (0.1, 0.0, 0.2)}, -0.1, ("no", None)),
        ({"big": (0.3, 0.2, 0.4), "small": (0.1, 0.05, 0.15)}, {"big": (0.1, 0.0, 0.2), "small": (0.1, 0.0, 0.2)}, -0.1, ("unclear", None)),
        ({"big": (0.3, 0.2, 0.4), "small": (-0.1, -0.2, 0.0)}, {"big": (0.2, 0.1, 0.3), "small": (0.0, -0.1, 0.05)}, 0.02, ("withheld", None)),
    ],
)
def test_heterogeneity_scenarios(spark, primary, baseline, control, expected):
    data = [("t", m, g, *v) for m, groups in (("primary", primary), ("baseline", baseline)) for g, v in groups.items()]
    controls = rows(spark, [("t", control)], "axis string, lo double")
    got = verdicts.heterogeneity(rows(spark, data, GROUP), controls, ["axis"]).first()
    assert (got.heterogeneity, got.nature) == expected


@pytest.mark.parametrize(
    "recovered,verdict", [("L1 L2 L3", "proceed"), ("L3 L4 L5", "hold"), ("L1 L2", "stop"), ("L1 L3 L4 L5", "proceed")]
)
def test_law_gate(spark, recovered, verdict):
    table = rows(spark, [(f"L{i}", f"L{i}" in recovered) for i in range(1, 6)], "law string, recovered boolean")
    assert verdicts.law_gate(table).first().verdict == verdict


def dataset(spark, **columns):
    data = pd.DataFrame(columns)
    data["mask"] = True
    return spark.createDataFrame(data)


def test_odd_law_passes_and_even_law_fails(spark):
    x = np.random.default_rng(0).uniform(-1, 1, 4000)
    odd = laws.symmetric_bins(dataset(spark, x1=x, y=np.tanh(2 * x)), "x1", "y")
    even = laws.symmetric_bins(dataset(spark, x1=x, y=x * x), "x1", "y")
    assert laws.measure_odd_monotone(odd).first().passed
    assert not laws.measure_odd_monotone(even).first().passed


def test_known_slopes_and_exponent(spark):
    rng = np.random.default_rng(1)
    x, symbol = rng.normal(size=4000), np.arange(4000) % 10
    line = dataset(spark, symbol=symbol, x1=x, y=2.0 * x + 0.01 * rng.normal(size=4000))
    got = laws.measure_affine(line, "symbol", "x1", "y").first()
    assert got.passed and np.isclose(got.slope_mean, 2.0, atol=0.01)
    v = rng.lognormal(size=4000)
    power = laws.measure_exponent(dataset(spark, x1=v, y=np.sqrt(v)), "x1", "y").first()
    assert power.passed and np.isclose(power.exponent, 0.5)


def test_decay_passes_and_a_line_does_not(spark):
    t = np.random.default_rng(2).uniform(0.05, 5, 6000)
    decay = laws.log_bins(dataset(spark, x1=t, y=1 + 3 * np.exp(-1.5 * t)), "x1", "y")
    line = laws.log_bins(dataset(spark, x1=t, y=5 * t), "x1", "y")
    assert laws.measure_decay(decay, laws.decay_grid()).first().passed
    assert not laws.measure_decay(line, laws.decay_grid()).first().passed


def test_outliers_are_flagged_not_dropped_with_copied_features(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    x[:5] = 50.0
    data = pd.DataFrame({"id": range(600), "a": x[:, 0], "b": x[:, 1], "copy": 2 * x[:, 0] - 1})
    got = selection.trust_region(spark.createDataFrame(data), ["a", "b", "copy"]).toPandas()
    assert len(got) == 600 and set(got[~got.on_manifold].id) >= set(range(5))
    chosen = selection.select_rows(spark.createDataFrame(data), ["a", "b"], ["id"], 100, seed=0).toPandas()
    assert len(chosen) == 100 and np.isclose(chosen.weight.sum(), 100)


def test_template_search_finds_the_structure(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=2000), rng.normal(size=2000)
    data = pd.DataFrame({"a": a, "b": b, "c": rng.normal(size=2000), "y": 3 * (a - b) + 1, "w": 1.0})
    best = formulas.template_search(spark.createDataFrame(data), ["a", "b", "c"], "y", "w").orderBy(F.desc("score")).first()
    assert best.template == "diff2" and np.isclose(best.score, 1.0)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2)) * [1.0, 5.0]
    y, w = x @ [1.0, -0.5] + rng.normal(size=400), rng.random(400) + 0.5
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "w": w}))
    _, models = references.ridge_path(df, df, ["a", "b"], "y", "w", alphas=(0.3,))
    mu = np.average(x, axis=0, weights=w)
    sd = np.sqrt(np.average((x - mu) ** 2, axis=0, weights=w))
    z, yc = (x - mu) / sd, y - np.average(y, weights=w)
    beta = np.linalg.solve((z * w[:, None]).T @ z / w.sum() + 0.3 * np.eye(2), z.T @ (w * yc) / w.sum())
    assert np.allclose(models[0.3]["coef"], beta / sd)


def test_heterogeneity_makes_no_row_per_draw(spark, monkeypatch):
    from tickloom.operators import bootstrap
    from tickloom.queries import predictions

    monkeypatch.setattr(bootstrap, "draw_counts", None)
    assert predictions.heterogeneity_verdict(spark, "/root/testdata/sf0.001").count() == 1
