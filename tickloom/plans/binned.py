"""R squared of bin means, for many replicates or many models over the same rows.

The bins are equal-count stretches along the prediction, so they move with the weights of a replicate and with the
model. Rows are never repeated per replicate: sums per slice of the order are reweighted, and only the
slices in which a bin ends are looked into.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import ratio
from tickloom.operators import bootstrap as boot
from tickloom.operators import metrics
from tickloom.operators.positions import piece_offsets, shuffled_positions
from tickloom.operators.sampling import fold_assignments
from tickloom.session import broadcast_if_small, cut_lineage

SLICE_ROWS = 65_536  # of a slice, while there are no more than MOST_SLICES
LEAST_SLICES = 64
MOST_SLICES = 1_024
DRAWN_CELLS = 4_000_000  # replicates by symbols whose draws a task holds at a time
REPS_AT_ONCE = 1_000  # replicates of a block of symbols that one task takes
GATHERED = 256  # symbols whose draws are multiplied at a time, so that they stay in cache
REPS_AT_ENDS = 200  # replicates whose draws one task holds for the rows of a slice in which they end a bin
ROWS_PER_BIN = 5  # fewer rows than this a bin make fewer bins


def bin_ends(total: Column, bins: int) -> Column:
    """Row counts at which bins end, the last one left out; the first ``total % bins`` bins have one more row."""
    count = F.when(total >= bins * ROWS_PER_BIN, F.lit(bins)).otherwise(F.greatest(F.floor(total / ROWS_PER_BIN), F.lit(1)))
    inner = F.when(count > 1, F.sequence(F.lit(1), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(inner, lambda j: j * F.floor(total / count) + F.least(j, total % count))


def r2_of_ends(ends: DataFrame, by: Sequence[str]) -> DataFrame:
    """``binned_r2`` per ``by`` from running sums ``swy``, ``swp``, ``sw`` at the bins' ends (column ``j``, in order)."""
    order = Window.partitionBy(*by).orderBy("j")
    own = {c: F.col(c) - F.coalesce(F.lag(c, 1).over(order), F.lit(0.0)) for c in ("swy", "swp", "sw")}
    means = ends.select(*by, *[c.alias(n) for n, c in own.items()]).select(
        *by, ratio(F.col("swy"), F.col("sw")).alias("mean_y"), ratio(F.col("swp"), F.col("sw")).alias("mean_pred"), F.col("sw").alias("weight")
    )
    return means.groupBy(*by).agg(
        metrics.weighted_r2(F.col("mean_y"), F.col("mean_pred"), F.col("weight")).alias("binned_r2")
    )


def _with_ends(cells: DataFrame, by: Sequence[str], place: str, bins: int) -> DataFrame:
    """Cells along an order with what lies before each, as ``b_*``, and the bin ends inside, as ``inside``."""
    upto = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = ("n", "swy", "swp", "sw")
    before = {f"b_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums}
    placed = cells.withColumns(before).withColumn("_total", F.sum("n").over(whole))
    ends = F.transform(bin_ends(F.col("_total"), bins), lambda e, j: F.struct((j + 1).alias("j"), e.cast("double").alias("at")))
    inside = F.filter(ends, lambda e: (e["at"] > F.col("b_n")) & (e["at"] <= F.col("b_n") + F.col("n")))
    return placed.withColumn("inside", inside)


def _last_ends(cells: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    return cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("swy", "swp", "sw")]).select(*by, F.lit(bins + 1).alias("j"), "swy", "swp", "sw")


def bootstrap_binned_r2(
    rows: DataFrame, counts: DataFrame, symbol: str, pred: str, y: str, w: str, tie: Sequence[str], bins: int = 20
) -> DataFrame:
    """``rep, binned_r2``: binned R squared when each row counts as often as its symbol was drawn.

    ``counts`` has ``rep``, ``symbol`` and ``times``. The order is by prediction, then ``tie``, then copy.
    """
    counts = cut_lineage(counts.select("rep", symbol, "times"))
    places = cut_lineage(shuffled_positions(counts.select(symbol).distinct(), [], [symbol], 0, "_place"))
    first, last = counts.agg(F.min("rep"), F.max("rep")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "rep long, binned_r2 double")
    width = _block_width(rows.sparkSession, places.count(), last + 1 - first)
    return _reweighted_r2(rows, places, boot.packed_counts(counts, places, symbol, width), width, first, last, symbol, pred, y, w, tie, bins)


def drawn_binned_r2(
    rows: DataFrame, members: DataFrame, symbol: str, pred: str, y: str, w: str, tie: Sequence[str], *, reps: int, seed: int | str, bins: int = 20
) -> DataFrame:
    """:func:`bootstrap_binned_r2` with the counts of ``draw_counts``, which are drawn in packs and never rows."""
    distinct = cut_lineage(members.select(symbol).distinct())  # read twice
    places = cut_lineage(shuffled_positions(distinct, [], [symbol], seed, "_place"))
    known = places.count()
    width = _block_width(rows.sparkSession, known, reps)
    drawn = boot.packed_draws(rows.sparkSession, known, width, reps=reps, seed=seed)
    return _reweighted_r2(rows, places, drawn, width, 0, reps - 1, symbol, pred, y, w, tie, bins)


def _block_width(spark: SparkSession, members: int, reps: int) -> int:
    """Symbols of a block: as many as a task holds the draws of, fewer where that makes too few tasks."""
    return max(1, min(DRAWN_CELLS // min(reps, REPS_AT_ONCE), -(-members // (2 * spark.sparkContext.defaultParallelism))))


def _reweighted_r2(rows, places, drawn, width, first, last, symbol, pred, y, w, tie, bins) -> DataFrame:
    """Replicates ``first`` to ``last`` with the draws of blocks of symbols.

    A row is in one slice of the order; each slice has sums per symbol. Sums and draws meet once, by blocks of symbols, and
    a block gives its part of every slice and replicate. A bin's end then lies in one slice per replicate: the draws of
    that slice's symbols in the replicates that end there are handed to its rows, which decide. There are no
    more slices than MOST_SLICES whatever the rows, so every step grows with the rows or with the symbols; past
    67 million rows the slices grow instead, of which a task holds one.
    """
    spark = rows.sparkSession
    weight = F.col(w).cast("double")
    laid = cut_lineage(
        rows.na.drop(subset=[pred, y, w]).orderBy(F.col(pred), *[F.col(t) for t in tie])
        .select(symbol, (weight * F.col(y)).alias("wy"), (weight * F.col(pred)).alias("wp"), weight.alias("w"), F.monotonically_increasing_id().alias("_id"))
    ).withColumn("_piece", F.shiftright("_id", 33))
    total = laid.count()
    if not total or not places.limit(1).count():
        return spark.createDataFrame([], "rep long, binned_r2 double")
    slices = min(max(LEAST_SLICES, total // SLICE_ROWS), MOST_SLICES)
    # One row per partition of the sorted rows.
    offsets = F.broadcast(piece_offsets(laid, [], "_piece"))
    place = F.col("_offset") + F.col("_id").bitwiseAND((1 << 33) - 1)
    ordered = laid.join(offsets, "_piece").withColumn("_at", place).withColumn("_slice", F.floor(F.col("_at") * slices / total).cast("int"))
    known = broadcast_if_small(places)
    spot = F.col("_place") - 1
    # Read twice: for the sums and for the draws of the slices in which bins end.
    sums = cut_lineage(
        ordered.groupBy("_slice", symbol).agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("wy").alias("swy"), F.sum("wp").alias("swp"), F.sum("w").alias("sw")
        ).join(known, symbol)
        .select("_slice", F.floor(spot / width).cast("int").alias("_block"), (spot % width).cast("int").alias("_spot"), "n", "swy", "swp", "sw")
    )
    drawn = cut_lineage(drawn.withColumn("_part", F.floor((F.col("rep") - first) / REPS_AT_ONCE).cast("int")))
    parts = F.explode(F.sequence(F.lit(0), F.lit((last - first) // REPS_AT_ONCE))).alias("_part")
    keys = ["_block", "_part"]

    def block_sums(key: tuple, own: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        low = first + key[1] * REPS_AT_ONCE
        reps = min(REPS_AT_ONCE, last + 1 - low)
        found, made = _by_slice(own), []
        times = boot.unpacked(draws["rep"] - low, draws["times"], width, reps)
        for _, part in found:
            values, spots, held = part[["n", "swy", "swp", "sw"]].to_numpy(), part["_spot"].to_numpy(), np.zeros((reps, 4))
            for i in range(0, len(part), GATHERED):
                held += times[spots[i : i + GATHERED]].T.astype(float) @ values[i : i + GATHERED]
            made.append(held)
        out = pd.DataFrame(np.concatenate(made) if made else np.zeros((0, 4)), columns=["n", "swy", "swp", "sw"])
        out.insert(0, "rep", np.tile(np.arange(low, low + reps), len(made)))
        out.insert(0, "_slice", np.repeat([k for k, _ in found], reps))
        return out

    cells = cut_lineage(
        sums.select("*", parts).groupBy(*keys).cogroup(drawn.groupBy(*keys))
        .applyInPandas(block_sums, "_slice int, rep long, n double, swy double, swp double, sw double")
        .groupBy("_slice", "rep").agg(*[F.sum(c).alias(c) for c in ("n", "swy", "swp", "sw")])
    )
    met = _with_ends(cells, ["rep"], "_slice", bins).select(
        "_slice", "rep", "b_n", "b_swy", "b_swp", "b_sw", F.explode("inside").alias("e")
    ).select("_slice", "rep", "b_swy", "b_swp", "b_sw", F.col("e.j").alias("j"), (F.col("e.at") - F.col("b_n")).alias("at"))
    # At most replicates x bins ends. A slice's replicates go in shares, so that a task holds few draws of its rows at a time.
    wanted = {int(k): own for k, own in met.toPandas().sort_values(["_slice", "rep", "j"]).groupby("_slice")}
    reps_of = {k: own["rep"].unique() for k, own in wanted.items()}
    shared = spark.sparkContext.broadcast((wanted, reps_of))
    shares = F.broadcast(spark.createDataFrame([(k, -(-len(r) // REPS_AT_ENDS)) for k, r in reps_of.items()], "_slice int, _shares int"))

    def block_draws(key: tuple, own: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        low, made = first + key[1] * REPS_AT_ONCE, []
        reps = min(REPS_AT_ONCE, last + 1 - low)
        times = boot.unpacked(draws["rep"] - low, draws["times"], width, reps)
        for k, part in _by_slice(own):
            for i in range(0, len(shared.value[1][k]), REPS_AT_ENDS):
                own_reps = shared.value[1][k][i : i + REPS_AT_ENDS]
                own_reps = own_reps[(own_reps >= low) & (own_reps < low + reps)]
                if len(own_reps):
                    chosen = times[part["_spot"].to_numpy()[:, None], own_reps - low]
                    made.append(pd.DataFrame({
                        "_slice": k, "_share": i // REPS_AT_ENDS, "_part": key[1], "_place": key[0] * width + part["_spot"] + 1, "times": [t.tobytes() for t in chosen],
                    }))
        shape = {"_slice": [], "_share": [], "_part": [], "_place": [], "times": []}
        return pd.concat(made) if made else pd.DataFrame(shape)

    chosen = (
        sums.join(shares, "_slice").select("_slice", "_block", "_spot", parts).groupBy(*keys).cogroup(drawn.groupBy(*keys))
        .applyInPandas(block_draws, "_slice int, _share int, _part int, _place long, times binary")
    )
    dealt = ordered.join(shares, "_slice").join(known, symbol).select(
        "_slice", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"), "_at", "_place", "wy", "wp", "w"
    )

    def at_ends(key: tuple, part: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        part, out = part.sort_values("_at"), []
        each, spots = part[["wy", "wp", "w"]].to_numpy(float), part["_place"].to_numpy()
        ends = shared.value[0][key[0]]
        reps = shared.value[1][key[0]][key[1] * REPS_AT_ENDS : (key[1] + 1) * REPS_AT_ENDS]
        for number, own in draws.groupby("_part"):
            own, low = own.sort_values("_place"), first + number * REPS_AT_ONCE
            own_reps = reps[(reps >= low) & (reps < low + REPS_AT_ONCE)]
            times = np.stack([np.frombuffer(t, f"<u{len(t) // len(own_reps)}") for t in own["times"]])  # blocks may differ in size of number
            at = np.searchsorted(own["_place"].to_numpy(), spots)
            for rep, own_ends in ends[ends["rep"].isin(own_reps)].groupby("rep"):
                drawn_times = times[:, np.searchsorted(own_reps, rep)][at].astype(float)
                upto = np.cumsum(drawn_times)
                for e in own_ends.itertuples():
                    k = int(np.searchsorted(upto, e.at, "left"))  # the row of which the end is a copy
                    held = drawn_times[: k + 1] @ each[: k + 1] - (upto[k] - e.at) * each[k]
                    out.append((rep, e.j, e.b_swy + held[0], e.b_swp + held[1], e.b_sw + held[2]))
        return pd.DataFrame(out, columns=["rep", "j", "swy", "swp", "sw"])

    ends = (
        dealt.groupBy("_slice", "_share").cogroup(chosen.groupBy("_slice", "_share"))
        .applyInPandas(at_ends, "rep long, j int, swy double, swp double, sw double")
    )
    made = r2_of_ends(ends.unionByName(_last_ends(cells, ["rep"], bins)), ["rep"])
    return spark.range(first, last + 1).withColumnRenamed("id", "rep").join(made, "rep", "left")


def _by_slice(sums: pd.DataFrame) -> list[tuple[int, pd.DataFrame]]:
    return [(int(k), own) for k, own in sums.groupby("_slice")]


# --- repeated k-fold -----------------------------------------------------------

CUTS = 4_096  # stretches of each repeat's predictions that are counted first
SAMPLE_ROWS = 16_384  # rows, by hash, that the cuts come from; they change the work, never the result
LEAST_ROWS = 30  # a fold with fewer training rows has no line


def kfold_scores(
    df: DataFrame,
    symbol: str,
    x: str,
    y: str,
    w: str,
    *,
    folds: int = 5,
    repeats: int = 20,
    seed: int | str = 0,
    bins: int = 20,
) -> DataFrame:
    """``rep, n, row_r2, binned_r2``: held-out scores of a line, weighted, inputs clamped to the training range.

    Symbols are dealt into folds anew in each repeat. The line is the plain least-squares one of the other
    folds, as is the range. Rows that tie in their prediction are shared out evenly among the bins that
    they reach across, so the score does not depend on the order of rows.

    All repeats are scored in two passes over the rows: sums per stretch of the predictions, then sums per value
    inside the stretches where a bin ends. Lines come from co-moments per symbol.
    """
    rows = df.na.drop(subset=[x, y, w]).select(symbol, *[F.col(c).cast("double").alias(f"_{n}") for n, c in (("x", x), ("y", y), ("w", w))])
    stats = cut_lineage(
        rows.groupBy(symbol).agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.avg("_x").alias("ax"), F.avg("_y").alias("ay"),
            F.covar_pop("_x", "_x").alias("vxx"), F.covar_pop("_x", "_y").alias("vxy"), F.min("_x").alias("lo"), F.max("_x").alias("hi"),
        )
    )
    center = stats.agg(
        ratio(F.sum(F.col("n") * F.col("ax")), F.sum("n")).alias("x"), ratio(F.sum(F.col("n") * F.col("ay")), F.sum("n")).alias("y"),
        F.sum("n").alias("n"),
    ).first()
    shape = "rep int, n long, row_r2 double, binned_r2 double"
    if center["x"] is None:
        return df.sparkSession.createDataFrame([], shape)
    dealt = cut_lineage(fold_assignments(stats, symbol, folds=folds, repeats=repeats, seed=seed))
    dx, dy = F.col("ax") - center["x"], F.col("ay") - center["y"]
    moments = {
        "n": F.col("n"), "sx": F.col("n") * dx, "sy": F.col("n") * dy,
        "sxx": F.col("n") * (F.col("vxx") + dx * dx), "sxy": F.col("n") * (F.col("vxy") + dx * dy),
    }
    held = dealt.join(stats, symbol).groupBy("rep", "fold").agg(
        *[F.sum(c).alias(n) for n, c in moments.items()], F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    # repeats x folds rows.
    lines = _fold_lines(held.toPandas(), repeats, folds, center)
    places = cut_lineage(dealt.groupBy(symbol).agg(F.transform(F.sort_array(F.collect_list(F.struct("rep", "fold"))), lambda s: s["fold"].cast("int")).alias("_folds")))
    # Read twice, the folds beside every row.
    ready = rows.join(places, symbol).select("_x", "_y", "_w", "_folds")

    # A share of the rows by hash, twice what is wanted at most: nothing is sorted and no task sends more than its share.
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(center["n"], 1.0))
    chosen = rows.filter(F.pmod(F.xxhash64(symbol, "_x", "_y", "_w"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = chosen.limit(2 * SAMPLE_ROWS).join(places, symbol).select("_x", "_folds").toPandas()
    known = _fold_predictions(sample["_x"].to_numpy(), np.array(sample["_folds"].tolist()).reshape(-1, repeats), lines)
    spots = np.linspace(0, 1, CUTS + 1)[1:-1]
    cuts = [np.unique(np.quantile(c[~np.isnan(c)], spots)) if (~np.isnan(c)).any() else np.zeros(0) for c in known.T]
    shared = df.sparkSession.sparkContext.broadcast((lines, cuts))
    middle = center["y"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            if batch.num_rows:
                at = np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1)
                xs, ys, ws = (batch.column(i).to_numpy() for i in range(3))
                yield _fold_predictions(xs, at, shared.value[0]), ys - middle, ws

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(c) + 1, 6)) for c in shared.value[1]]
        for preds, ys, ws in each(batches):
            for rep, at in enumerate(shared.value[1]):
                p = preds[:, rep] - middle
                own = ~np.isnan(p)
                p, yy, ww = p[own], ys[own], ws[own]
                bucket = np.searchsorted(at, preds[own, rep], "right")
                for k, v in enumerate((np.ones(len(p)), ww * yy, ww * p, ww, ww * yy * yy, ww * (yy - p) ** 2)):
                    totals[rep][:, k] += np.bincount(bucket, weights=v, minlength=len(totals[rep]))
        for rep, sums in enumerate(totals):
            used = np.flatnonzero(sums[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), rep, np.int32)), pa.array(used.astype(np.int32)), *[pa.array(sums[used, k]) for k in range(6)]],
                ["rep", "stretch", "n", "swy", "swp", "sw", "swyy", "sse"],
            )

    cells = cut_lineage(
        ready.mapInArrow(stretches, "rep int, stretch int, n double, swy double, swp double, sw double, swyy double, sse double")
        .groupBy("rep", "stretch").agg(*[F.sum(c).alias(c) for c in ("n", "swy", "swp", "sw", "swyy", "sse")])
    )
    met = cut_lineage(
        _with_ends(cells, ["rep"], "stretch", bins).filter(F.size("inside") > 0)
        .select("rep", "stretch", "inside", *[F.col(f"b_{c}").alias(f"f_{c}") for c in ("n", "swy", "swp", "sw")])
    )
    # At most repeats x bins stretches.
    wanted: dict[int, np.ndarray] = {r: np.sort(g["stretch"].to_numpy()) for r, g in met.select("rep", "stretch").toPandas().groupby("rep")}

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for preds, ys, ws in each(batches):
            for rep, at in wanted.items():
                bucket = np.searchsorted(shared.value[1][rep], preds[:, rep], "right")
                own = np.isin(bucket, at) & ~np.isnan(preds[:, rep])
                p, where = np.unique(preds[own, rep], return_inverse=True)
                sums = [np.bincount(where, weights=v, minlength=len(p)) for v in (np.ones(own.sum()), ws[own] * ys[own], ws[own] * (preds[own, rep] - middle), ws[own])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p), rep, np.int32)), pa.array(np.searchsorted(shared.value[1][rep], p, "right").astype(np.int32)), pa.array(p), *map(pa.array, sums)],
                    ["rep", "stretch", "p", "n", "swy", "swp", "sw"],
                )

    inside = (
        ready.mapInArrow(values, "rep int, stretch int, p double, n double, swy double, swp double, sw double")
        .groupBy("rep", "stretch", "p").agg(*[F.sum(c).alias(c) for c in ("n", "swy", "swp", "sw")])
    )
    upto = Window.partitionBy("rep", "stretch").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = ("n", "swy", "swp", "sw")
    placed = inside.join(met, ["rep", "stretch"]).withColumns(
        {f"b_{c}": F.col(f"f_{c}") + F.coalesce(F.sum(c).over(upto), F.lit(0.0)) for c in sums}
    )
    reached = F.filter("inside", lambda e: (e["at"] > F.col("b_n")) & (e["at"] <= F.col("b_n") + F.col("n")))
    share = (F.col("e.at") - F.col("b_n")) / F.col("n")
    ends = placed.withColumn("e", F.explode(reached)).select(
        "rep", F.col("e.j").alias("j"), *[(F.col(f"b_{c}") + share * F.col(c)).alias(c) for c in sums[1:]]
    )
    binned = r2_of_ends(ends.unionByName(_last_ends(cells, ["rep"], bins)), ["rep"])
    spread = F.sum("swyy") - ratio(F.sum("swy") * F.sum("swy"), F.sum("sw"))
    row = cells.groupBy("rep").agg(
        F.sum("n").cast("long").alias("n"), (1.0 - ratio(F.sum("sse"), F.when(spread > 0, spread))).alias("row_r2")
    )
    return row.join(binned, "rep", "left").select("rep", "n", "row_r2", "binned_r2")


def _fold_lines(held: pd.DataFrame, repeats: int, folds: int, center) -> np.ndarray:
    """(repeats, folds, 4): intercept, slope and range of the other folds; NaN where they give no line."""
    out = np.full((repeats, folds, 4), np.nan)
    for rep, own in held.groupby("rep"):
        for fold in own["fold"]:
            rest = own[own["fold"] != fold]
            n, sx, sy, sxx, sxy = (float(rest[c].sum()) for c in ("n", "sx", "sy", "sxx", "sxy"))
            if n < LEAST_ROWS or (var := sxx - sx * sx / n) <= n * 1e-24:
                continue
            slope = (sxy - sx * sy / n) / var
            intercept = center["y"] + sy / n - slope * (center["x"] + sx / n)
            out[rep, fold] = intercept, slope, rest["lo"].min(), rest["hi"].max()
    return out


def _fold_predictions(x: np.ndarray, folds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Predictions (rows, repeats) of the line of each row's fold."""
    own = lines[np.arange(lines.shape[0])[None, :], folds]
    return own[..., 0] + own[..., 1] * np.clip(x[:, None], own[..., 2], own[..., 3])
