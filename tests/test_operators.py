"""Operators against NumPy or a plain single-window version, with ties, gaps and one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import book
from tickloom.functions.clock import packed_to_micros
from tickloom.operators import bootstrap, frames, joins, metrics, ranking, sampling
from tickloom.operators.asof import fill_flag, forward_asof, lookback_count
from tickloom.operators.moments import co_moments, weighted_correlations
from tickloom.operators.positions import (
    positions_by_piece,
    shuffled_positions,
    sorted_positions,
    tile,
)
from tickloom.operators.quantiles import grouped_quantiles
from tickloom.operators.windows import causal_windows, run_ids, with_prior_quantiles


@pytest.fixture(scope="module")
def ticks():
    """Three symbols, the first with most rows; times with ties and long gaps."""
    rng = np.random.default_rng(3)
    parts = []
    for symbol, n in ((0, 120), (1, 31), (2, 5)):
        t = np.sort(rng.integers(0, 60, n)) * 1_000_000
        t[n // 2 :] += 500_000_000
        value = rng.normal(size=n).round(3)
        value[rng.random(n) < 0.2] = np.nan
        parts.append(
            pd.DataFrame({"symbol": symbol, "seq": np.arange(1, n + 1), "t": t, "x": rng.normal(size=n), "gap": value})
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, ticks):
    return spark.createDataFrame(ticks).withColumn("gap", F.when(~F.isnan("gap"), F.col("gap"))).cache()


def collected(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_positions_follow_the_order_across_pieces(frame, ticks):
    placed = positions_by_piece(frame, ["symbol"], F.floor(F.col("t") / 10_000_000), ["t", "seq"], "pos")
    got = collected(placed, "symbol", "seq")
    assert (got.pos == got.seq).all() and len(got) == len(ticks)


def test_at_most_keeps_the_first_rows_of_each_key(frame):
    placed = positions_by_piece(frame, ["symbol"], F.floor(F.col("t") / 10_000_000), ["t", "seq"], "pos", at_most=4)
    assert placed.groupBy("symbol").count().filter("count != 4").count() == 0
    assert placed.agg(F.max("seq")).first()[0] == 4


def test_shuffled_positions_are_a_permutation_and_repeatable(frame):
    def run(parts):
        return collected(
            shuffled_positions(frame.repartition(parts), ["symbol"], ["symbol", "seq"], 4, "pos", pieces=8), "symbol", "seq"
        ).pos.tolist()

    first = run(3)
    assert first == run(7)
    got = collected(shuffled_positions(frame, ["symbol"], ["symbol", "seq"], 4, "pos"), "symbol", "pos")
    assert (got.groupby("symbol").pos.apply(lambda s: (np.sort(s) == np.arange(1, len(s) + 1)).all())).all()


def test_sorted_positions_match_a_global_sort(frame, ticks):
    got = collected(sorted_positions(frame, [], [F.col("x"), F.col("symbol"), F.col("seq")], "pos"), "pos")
    assert got.x.tolist() == sorted(ticks.x)
    assert got.pos.tolist() == list(range(1, len(ticks) + 1))


@pytest.mark.parametrize("n,tiles", [(10, 3), (20, 20), (7, 10), (100, 7)])
def test_tile_matches_array_split(spark, n, tiles):
    rows = spark.range(1, n + 1).select(F.col("id"), tile(F.col("id"), F.lit(n), tiles).alias("b"))
    sizes = [r[1] for r in rows.groupBy("b").count().orderBy("b").collect()]
    assert sizes == [len(a) for a in np.array_split(np.arange(n), tiles) if len(a)]


def test_chunked_rows_equal_one_window(frame):
    def build(d, w):
        return d.withColumns(
            {
                "lagged": F.lag("x", 3).over(w),
                "ahead": F.lead("x", 2).over(w),
                "mean": book.rolling_mean("x", w, 5),
            }
        )

    chunked = collected(frames.over_rows(frame, ["symbol"], "seq", build, before=5, after=2, chunk_rows=4), "symbol", "seq")
    whole = collected(build(frame, Window.partitionBy("symbol").orderBy("seq")), "symbol", "seq")
    pd.testing.assert_frame_equal(chunked[whole.columns], whole)


def test_carried_scans_equal_one_window(frame):
    w = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    want = collected(
        frame.withColumns({"total": F.sum("x").over(w), "filled": F.coalesce(F.last("gap", True).over(w), F.lit(0.0))}),
        "symbol", "seq",
    )
    total = collected(frames.running_total(frame, ["symbol"], "seq", {"total": F.col("x")}, chunk_rows=6), "symbol", "seq")
    assert np.allclose(total.total, want.total)
    filled = collected(
        frames.forward_fill(frame, ["symbol"], "seq", ["gap"], default=0.0, chunk_rows=6), "symbol", "seq"
    )
    assert np.allclose(filled.gap, want.filled)


def test_rolling_windows_of_large_values_and_nan(spark):
    """One method for all sizes: a small spread around 1e8 is kept, a NaN ends with its frame."""
    big = 1e8 + np.arange(200) % 3
    holed = np.ones(200) * 2.0
    holed[50] = np.nan
    rows = spark.createDataFrame(pd.DataFrame({"symbol": "a", "seq": range(1, 201), "big": big, "holed": holed}))
    requests = {"std": ("std", "big", 40), "z": ("zscore", "big", 40), "mean": ("mean", "holed", 40)}

    def add(d, w):
        return book.with_rolling(d, w, requests, zscore_min=5)

    got = collected(frames.over_rows(rows, ["symbol"], "seq", add, before=41, chunk_rows=50), "symbol", "seq")
    want = pd.Series(big).rolling(40).std()
    assert np.allclose(got["std"].astype(float)[39:], want[39:])
    assert np.allclose(got.z.astype(float)[40:], ((big - pd.Series(big).rolling(40).mean()) / want)[40:])
    assert got["mean"].astype(float)[199] == 2.0


def test_every_replicate_is_kept(spark):
    """A contract seen in one symbol of twenty: replicates that miss it are counted, not lost."""
    symbols = spark.createDataFrame([(f"s{i}",) for i in range(20)], "symbol string")
    stats = spark.createDataFrame([("s0", "a", 3.0, 2.0), ("s1", "b", 1.0, 0.0)], "symbol string, contract string, num double, den double")
    counts = bootstrap.draw_counts(symbols, [], "symbol", reps=1000, seed=1)
    out = {r.contract: r for r in bootstrap.ratio_interval(counts, stats, "symbol", ["contract"], "num", "den", {"lo": 0.025, "hi": 0.975}).collect()}
    assert 200 < out["a"].null_reps < 600 and out["a"].lo == out["a"].hi == 1.5
    assert out["b"].null_reps == 1000 and out["b"].lo is None


@pytest.mark.parametrize("how", ["linear", "lower", "higher"])
@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_quantiles_are_exact_with_hot_groups_and_ties(spark, how, accuracy):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"k": rng.integers(0, 6, 5000), "v": rng.normal(size=5000).round(2)})
    data.loc[:1700, "k"] = 0
    data.loc[1000:2500, "v"] = 0.25
    probs = {"a": 0.0, "b": 1 / 3, "c": 0.5, "d": 0.99, "e": 1.0}
    df = spark.createDataFrame(data)
    got = grouped_quantiles(df, ["k"], "v", probs, how=how, accuracy=accuracy).toPandas().set_index("k").sort_index()
    for k, part in data.groupby("k"):
        want = [np.quantile(part.v, p, method=how) for p in probs.values()]
        assert np.allclose(got.loc[k, list(probs)], want)
    whole = grouped_quantiles(df, [], "v", probs, how=how, accuracy=accuracy).first()
    assert np.allclose(list(whole), [np.quantile(data.v, p, method=how) for p in probs.values()])


def test_quantiles_skip_missing_and_accept_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("b", None)], "k string, v double")
    assert [tuple(r) for r in grouped_quantiles(df, ["k"], "v", {"m": 0.5}).collect()] == [("a", 1.0)]
    assert grouped_quantiles(df.filter("k = 'b'"), [], "v", {"m": 0.5}).count() == 0


def test_forward_asof_matches_searchsorted(frame, ticks):
    got = collected(
        forward_asof(frame, ["symbol"], "t", "seq", horizon_us=3_000_000, take={"hit": "seq"}, bucket_us=7_000_000),
        "symbol", "seq",
    )
    for _, part in got.groupby("symbol"):
        t = part.t.to_numpy()
        at = np.searchsorted(t, t + 3_000_000, side="left")
        want = [i + 1 if i < len(t) else None for i in at]
        assert [None if pd.isna(x) else int(x) for x in part.hit] == want
    assert len(got) == len(ticks)


def test_lookback_count_matches_searchsorted(frame):
    got = collected(
        lookback_count(frame, ["symbol"], "t", "seq", span_us=4_000_000, bucket_us=5_000_000), "symbol", "seq"
    )
    for _, part in got.groupby("symbol"):
        t = part.t.to_numpy()
        assert part.recent_count.tolist() == (np.arange(len(t)) - np.searchsorted(t, t - 4_000_000, side="left")).tolist()


def _fills(spark, n, prints, step_us):
    rows = [
        ("s", i + 1, i * step_us, 100.0, 95.0 if i in prints else None) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "symbol string, seq long, t long, bid1 double, sell double")
    flagged = fill_flag(
        df, ["symbol"], "t", "seq", sell_min="sell", limit_price="bid1", max_rows=100, max_us=10_000_000, chunk_rows=37
    )
    return collected(flagged, "seq").y_fill.tolist()


def test_fill_needs_a_later_print_within_both_bounds(spark):
    y = _fills(spark, 400, {5, 300}, 10_000)
    assert y[0] == 1.0 and y[250] == 1.0 and y[120] == 0.0 and y[5] == 0.0 and y[300] == 0.0
    assert _fills(spark, 210, {105}, 10_000)[:6] == [0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    assert _fills(spark, 60, {50}, 1_000_000)[39:42] == [0.0, 1.0, 1.0]


def test_prior_quantile_is_the_upper_neighbour_of_earlier_rows(frame):
    got = collected(with_prior_quantiles(frame, ["symbol"], "seq", "x", {"q": 0.7}, size=10, chunk_rows=16), "symbol", "seq")
    for _, part in got.groupby("symbol"):
        want = part.x.shift(1).rolling(10).quantile(0.7, interpolation="higher")
        assert (part.q.isna() == want.isna()).all() and np.allclose(part.q.dropna(), want.dropna())


def test_causal_windows_ignore_the_future(frame):
    def run(df):
        return collected(causal_windows(df, ["symbol"], "seq", ["x", "gap"], size=4, chunk_rows=8), "symbol", "seq")

    clean = run(frame)
    broken = run(frame.withColumn("x", F.when(F.col("seq") > 20, F.lit(1e9)).otherwise(F.col("x"))))
    early = clean.seq <= 20
    assert clean.window[early].map(tuple).tolist() == broken.window[early].map(tuple).tolist()
    first = clean[clean.seq == 1].iloc[0]
    assert list(first.window) == list(first.window[:2]) * 4


def test_run_ids_count_changes(spark):
    rows = [("s", i + 1, v) for i, v in enumerate("aabbbacc")]
    got = collected(run_ids(spark.createDataFrame(rows, "symbol string, seq long, v string"), ["symbol"], "seq", "v", chunk_rows=3), "seq")
    assert got.run_id.tolist() == [0, 0, 1, 1, 1, 2, 3, 3]


def test_packed_clock(spark):
    row = spark.range(1).select(packed_to_micros(F.lit(93015_250000)).alias("t")).first()
    assert row.t == (9 * 3600 + 30 * 60 + 15) * 1_000_000 + 250_000


def test_permutation_keeps_the_values_of_each_group(frame):
    mixed = collected(sampling.permute_within(frame, ["symbol"], "seq", "x", 1, "px"), "symbol", "seq")
    for _, part in mixed.groupby("symbol"):
        assert sorted(part.x) == sorted(part.px)
    assert (mixed.x != mixed.px).mean() > 0.9


def test_split_keeps_single_members_in_fit(spark):
    members = spark.createDataFrame([("a", 1)] + [("b", i) for i in range(9)], "stratum string, id long")
    got = collected(sampling.stratified_split(members, "stratum", "id", 0), "id")
    assert got[got.stratum == "a"].role.tolist() == ["fit"]
    assert (got[got.stratum == "b"].role == "select").sum() == 3


def test_disjointness_is_enforced(spark):
    a, b = spark.range(3).toDF("k"), spark.range(2, 5).toDF("k")
    with pytest.raises(ValueError):
        ranking.assert_disjoint({"a": a, "b": b}, "k")
    ranking.assert_disjoint({"a": a, "b": spark.range(10, 12).toDF("k")}, "k")


def test_pairing_refuses_misaligned_tables(spark):
    a = spark.createDataFrame([(1, 1.0, 0.1), (2, 2.0, 0.2)], "k long, y double, p double")
    with pytest.raises(ValueError):
        joins.pair_predictions(a, a.withColumn("y", F.col("y") + 1), ["k"], "y", "p", "p")
    assert joins.pair_predictions(a, a, ["k"], "y", "p", "p").count() == 2


def test_spearman_shares_tied_ranks(spark):
    data = pd.DataFrame({"x": [1, 2, 2, 3, 3, 3, 9], "y": [5, 1, 4, 4, 8, 8, 2]}).astype(float)
    want = data.x.rank().corr(data.y.rank())
    assert np.isclose(metrics.spearman(spark.createDataFrame(data), "x", "y").first()[0], want)


def test_co_moments_match_numpy_and_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = x @ [2.0, 3.0, 1.5] + 0.7 + 0.1 * rng.normal(size=500)
    w = rng.random(500) + 0.5
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "w": w})).repartition(7)
    holes = rows.union(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 1.0, 1.0)], rows.schema))
    got = co_moments(holes, ["a", "b", "c", "y"], "w")
    block = np.column_stack([x, y])
    assert got.n == 500 and np.isclose(got.weight, w.sum()) and np.allclose(got.mean, np.average(block, axis=0, weights=w))
    assert np.allclose(got.cov, np.cov(block.T, aweights=w, ddof=0))
    plain = co_moments(holes, ["a", "b", "c", "y"])
    assert np.allclose(plain.sample_cov, np.cov(block.T))
    fit = metrics.linear_fit(plain)
    assert np.allclose([*fit["coef"], fit["intercept"]], np.linalg.lstsq(np.column_stack([x, np.ones(500)]), y, rcond=None)[0])
    assert co_moments(holes.filter("a > 99"), ["a", "b"]).n == 0


def test_a_column_far_from_zero_keeps_its_correlation(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=4000), rng.random(4000) + 0.1
    y = 0.6 * x + 0.8 * rng.normal(size=4000)
    data = {"near": x, "far": x + 1e9, "y": y + 1e9, "w": w, "constant": np.full(4000, 1e9), "few": np.where(np.arange(4000) < 9, x, np.nan)}
    rows = spark.createDataFrame(pd.DataFrame(data)).repartition(9)
    got = {r["input"]: r for r in weighted_correlations(rows, ["near", "far", "constant", "few"], "y", "w").collect()}
    cov = np.cov(np.vstack([x, y]), aweights=w)
    want = cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1])
    assert np.isclose(got["near"].r, want, atol=1e-6) and np.isclose(got["far"].r, want, atol=1e-6)
    assert got["constant"].r is None and got["few"].r is None and got["few"].n == 9
    wide = co_moments(rows, ["far", "y"])
    assert np.isclose(wide.cov[0, 1], np.cov(x, y, ddof=0)[0, 1], rtol=1e-6)
    assert {r["input"] for r in weighted_correlations(rows.filter("w > 9"), ["near", "far"], "y", "w").collect()} == {"near", "far"}


def test_many_draws_at_once_are_those_of_the_column(spark):
    from tickloom.functions.draws import draw, draws_upto

    for keys in (("5", 0), (5, 1, 123456), ("s" * 60, 7)):  # the last one is longer than a block of MD5
        made = spark.range(1, 1_201).select("id", draw(keys[0], *[F.lit(k) for k in keys[1:]], F.col("id")).alias("d"))
        assert [r.d for r in made.orderBy("id").collect()] == draws_upto(1_200, *keys).tolist()


def test_small_groups_are_shuffled_whole(frame):
    placed = shuffled_positions(frame, ["symbol"], ["symbol", "seq"], 4, "pos")
    assert "Join" not in placed._jdf.queryExecution().optimizedPlan().toString()
    pieces = shuffled_positions(frame, ["symbol"], ["symbol", "seq"], 4, "pos", pieces=8)
    assert collected(placed, "symbol", "seq")["pos"].tolist() == collected(pieces, "symbol", "seq")["pos"].tolist()
