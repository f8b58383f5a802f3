"""Reference models, weighted k-fold and the binned bootstrap against row-wise versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bootstrap as boot
from tickloom.operators.sampling import fold_assignments
from tickloom.plans import binned, references
from tickloom.plans.laws import decay_grid


def weighted_r2(y, p, w):
    mean = np.average(y, weights=w)
    return 1 - np.sum(w * (y - p) ** 2) / np.sum(w * (y - mean) ** 2)


def binned_r2(y, p, w, bins):
    """Rows in the order given, ties in that order."""
    order = np.argsort(p, kind="stable")
    parts = np.array_split(order, min(bins, max(1, len(p) // 5)) if len(p) < bins * 5 else bins)
    mean = lambda v: np.array([np.average(v[i], weights=w[i]) for i in parts])
    return weighted_r2(mean(y), mean(p), np.array([w[i].sum() for i in parts]))


@pytest.fixture(scope="module")
def panel():
    """Symbols of unequal size; the first reaches far beyond the others' inputs."""
    rng = np.random.default_rng(8)
    parts = []
    for s in range(23):
        n = 400 if s == 0 else int(rng.integers(5, 60))
        x = rng.normal(size=n) * (6 if s == 0 else 1) + rng.normal()
        parts.append(pd.DataFrame({"symbol": f"s{s:02d}", "seq": np.arange(n), "x": x, "y": 0.8 * x + rng.normal(size=n) + 1e4, "w": rng.random(n) + 0.2}))
    return pd.concat(parts, ignore_index=True)


def test_kfold_scores_are_those_of_the_rows(spark, panel):
    rows = spark.createDataFrame(panel).repartition(5)
    holes = rows.unionByName(spark.createDataFrame([("s01", 1, None, 1.0, 1.0), ("s30", 1, None, 2.0, 1.0)], rows.schema))
    got = {r.rep: r for r in binned.kfold_scores(holes, "symbol", "x", "y", "w", folds=4, repeats=6, seed=3, bins=15).collect()}
    dealt = fold_assignments(rows.select("symbol"), "symbol", folds=4, repeats=6, seed=3).toPandas()
    assert sorted(got) == list(range(6))
    for rep, own in dealt.groupby("rep"):
        fold = panel.symbol.map(dict(zip(own.symbol, own.fold)))
        pred = np.empty(len(panel))
        for f in range(4):
            train, test = panel[fold != f], fold == f
            slope, intercept = np.polyfit(train.x, train.y, 1)
            pred[test] = intercept + slope * np.clip(panel.x[test], train.x.min(), train.x.max())
        y, w = panel.y.to_numpy(), panel.w.to_numpy()
        assert got[rep].n == len(panel) and np.isclose(got[rep].row_r2, weighted_r2(y, pred, w), atol=1e-9)
        # Rows clamped to one value tie; the others do not, and the ties lie inside a bin or share its end evenly.
        assert np.isclose(got[rep].binned_r2, binned_r2(y, pred, w, 15), atol=5e-3)


def test_kfold_ties_do_not_depend_on_the_order(spark):
    rows = [(f"s{i % 6}", float(i % 4), float(i % 7), 1.0 + i % 3) for i in range(300)]
    names = "symbol string, x double, y double, w double"
    one = binned.kfold_scores(spark.createDataFrame(rows, names), "symbol", "x", "y", "w", folds=3, repeats=3, bins=7).orderBy("rep").collect()
    other = binned.kfold_scores(spark.createDataFrame(rows[::-1], names).repartition(11), "symbol", "x", "y", "w", folds=3, repeats=3, bins=7).orderBy("rep").collect()
    for a, b in zip(one, other, strict=True):
        assert np.allclose([a.row_r2, a.binned_r2], [b.row_r2, b.binned_r2])
    assert binned.kfold_scores(spark.createDataFrame([], names), "symbol", "x", "y", "w").count() == 0


@pytest.mark.parametrize("cells", [4_000_000, 50])
def test_binned_bootstrap_repeats_rows_only_in_thought(spark, panel, monkeypatch, cells):
    monkeypatch.setattr(binned, "DRAWN_CELLS", cells)
    monkeypatch.setattr(binned, "LEAST_SLICES", 9)
    rng = np.random.default_rng(2)
    symbols = panel.symbol.unique()
    data = panel.assign(p=panel.x.round(1))  # many ties, broken by symbol and sequence
    draws = [rng.integers(0, len(symbols), len(symbols)) for _ in range(7)]
    counts = [(r, symbols[k], int(c)) for r, d in enumerate(draws) for k, c in zip(*np.unique(d, return_counts=True))]
    made = binned.bootstrap_binned_r2(
        spark.createDataFrame(data).repartition(6), spark.createDataFrame(counts, "rep long, symbol string, times long"),
        "symbol", "p", "y", "w", ["symbol", "seq"], bins=11,
    )
    got = {r.rep: r.binned_r2 for r in made.collect()}
    ordered = data.sort_values(["p", "symbol", "seq"])
    for rep, d in enumerate(draws):
        times = ordered.symbol.map(dict(zip(*np.unique(symbols[d], return_counts=True)))).fillna(0).astype(int)
        drawn = ordered.loc[ordered.index.repeat(times)]
        assert np.isclose(got[rep], binned_r2(drawn.y.to_numpy(), drawn.p.to_numpy(), drawn.w.to_numpy(), 11))
    assert len(got) == 7


@pytest.mark.parametrize(("cells", "at_once", "at_ends"), [(4_000_000, 1_000, 200), (50, 1_000, 2), (30, 4, 1)])
def test_binned_bootstrap_reads_the_rows_as_often_for_many_symbols(spark, panel, monkeypatch, cells, at_once, at_ends):
    monkeypatch.setattr(binned, "DRAWN_CELLS", cells)
    monkeypatch.setattr(binned, "REPS_AT_ONCE", at_once, raising=False)
    monkeypatch.setattr(binned, "REPS_AT_ENDS", at_ends, raising=False)
    monkeypatch.setattr(binned, "LEAST_SLICES", 9)
    staged, stage = [], binned.cut_lineage
    monkeypatch.setattr(binned, "cut_lineage", lambda df: staged.append(df) or stage(df))
    rows = spark.createDataFrame(panel.assign(p=panel.x.round(1)))
    order = ["symbol", "p", "y", "w", ["symbol", "seq"]]
    members = rows.select("symbol").union(spark.createDataFrame([("s99",), (None,)], "symbol string"))  # members without rows
    counts = boot.draw_counts(members.distinct(), [], "symbol", reps=9, seed=3)
    given = {r.rep: r.binned_r2 for r in binned.bootstrap_binned_r2(rows, counts, *order, bins=11).collect()}
    assert len(staged) == 6  # before, two and one more for each round of replicates
    drawn = {r.rep: r.binned_r2 for r in binned.drawn_binned_r2(rows, members, *order, reps=9, seed=3, bins=11).collect()}
    data = panel.assign(p=panel.x.round(1)).sort_values(["p", "symbol", "seq"])
    times = counts.toPandas()
    assert sorted(given) == sorted(drawn) == list(range(9))
    for rep, own in times.groupby("rep"):
        often = data.symbol.map(dict(zip(own.symbol, own.times))).fillna(0).astype(int)
        copies = data.loc[data.index.repeat(often)]
        want = binned_r2(copies.y.to_numpy(), copies.p.to_numpy(), copies.w.to_numpy(), 11)
        assert np.isclose(given[rep], want) and np.isclose(drawn[rep], want)


def test_binned_bootstrap_of_few_rows_and_of_large_counts(spark, monkeypatch):
    monkeypatch.setattr(binned, "DRAWN_CELLS", 3)  # a block for each symbol
    rows = spark.createDataFrame([(f"s{i % 3}", i, float(i % 5), float(i * i % 7), 1.0 + i % 2) for i in range(12)], "symbol string, seq long, p double, y double, w double")
    order = ["symbol", "p", "y", "w", ["symbol", "seq"]]
    counts = [(0, "s0", 300), (0, "s1", 2), (2, "s2", 70_000), (2, "s0", 1)]  # no draws in replicate 1
    got = {r.rep: r.binned_r2 for r in binned.bootstrap_binned_r2(rows, spark.createDataFrame(counts, "rep long, symbol string, times long"), *order, bins=4).collect()}
    data = rows.toPandas().sort_values(["p", "symbol", "seq"])
    for rep in (0, 2):
        often = data.symbol.map({s: n for r, s, n in counts if r == rep}).fillna(0).astype(int)
        copies = data.loc[data.index.repeat(often)]
        assert np.isclose(got[rep], binned_r2(copies.y.to_numpy(), copies.p.to_numpy(), copies.w.to_numpy(), 4))
    assert set(got) == {0, 1, 2} and got[1] is None
    few = binned.drawn_binned_r2(rows.limit(1), rows.select("symbol"), *order, reps=2, seed=1).collect()
    assert [r.binned_r2 for r in few] == [None, None]
    assert binned.drawn_binned_r2(rows.limit(0), rows.select("symbol"), *order, reps=2, seed=1).count() == 0


def test_step_curve_and_its_odd_form(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=4000)
    y = np.tanh(2 * x) + 0.3 * rng.normal(size=4000)
    fit = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    score = spark.createDataFrame([(v,) for v in [*np.linspace(-4, 4, 33).tolist(), None]], "x double")
    free = {r.x: r.pred for r in references.step_curve(fit, score, "x", "y", bins=20).collect()}
    reach = np.quantile(np.abs(x), 0.95)
    place = np.clip(np.floor((x + reach) / (2 * reach) * 20), 0, 19)
    for v, p in free.items():
        if v is not None:
            assert np.isclose(p, y[place == np.clip(np.floor((v + reach) / (2 * reach) * 20), 0, 19)].mean())
    assert free[None] is None
    odd = [r.pred for r in references.step_curve(fit, score.filter("x IS NOT NULL"), "x", "y", bins=20, odd=True).orderBy("x").collect()]
    assert all(b >= a - 1e-12 for a, b in zip(odd, odd[1:])) and np.isclose(odd[0], -odd[-1])
    assert references.step_curve(fit.limit(5), score, "x", "y").filter("pred IS NOT NULL").count() == 0


def test_isotonic_pools_are_the_least_squares_ones():
    rng = np.random.default_rng(6)
    for _ in range(30):
        v, w = rng.normal(size=9).tolist(), (rng.random(9) + 0.1).tolist()
        want = [max(min(np.average(v[a : b + 1], weights=w[a : b + 1]) for b in range(i, 9)) for a in range(i + 1)) for i in range(9)]
        assert np.allclose(references._isotonic(v, w), want)
    falling = references.odd_and_monotone({0: 5, 1: 5, 2: 5, 3: 5}, {0: 2.0, 1: 1.0, 2: -1.2, 3: -2.0}, 4)
    assert np.allclose([falling[b] for b in range(4)], [2.0, 1.1, -1.1, -2.0])


def test_decay_reference_clamps_and_follows_the_curve(spark):
    rng = np.random.default_rng(7)
    t = rng.uniform(0.05, 6, 6000)
    fit = spark.createDataFrame(pd.DataFrame({"t": t, "y": 0.4 + 2 * np.exp(-1.3 * t) + 0.05 * rng.normal(size=6000)}))
    score = spark.createDataFrame([(v,) for v in (1e-9, 0.5, 1.0, 3.0, 50.0, 0.0, None)], "t double")
    got = {r.t: r.pred for r in references.decay(fit, score, "t", "y", decay_grid(steps=60)).collect()}
    for v in (0.5, 1.0, 3.0):
        assert abs(got[v] - (0.4 + 2 * np.exp(-1.3 * v))) < 0.05
    lo, hi = np.quantile(t, [0.02, 0.98])
    assert abs(got[1e-9] - (0.4 + 2 * np.exp(-1.3 * lo))) < 0.1 and abs(got[50.0] - (0.4 + 2 * np.exp(-1.3 * hi))) < 0.05
    assert got[0.0] is None and got[None] is None
    assert references.decay(fit.limit(20), score, "t", "y", decay_grid()).filter(F.col("pred").isNotNull()).count() == 0
