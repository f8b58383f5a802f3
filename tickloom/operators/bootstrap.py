"""Symbol bootstraps from sufficient statistics.

Rows are reduced to a few sums per symbol once; a replicate then only reweights symbols.
Draws depend on the seed, the replicate and the slot number, so every replicate is
reproducible whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.draws import draw, draws_upto
from tickloom.functions.numeric import ratio, ratio_if_positive
from tickloom.operators.positions import shuffled_positions
from tickloom.session import cut_lineage

CI95 = (0.025, 0.975)


def draw_counts(
    members: DataFrame, groups: Sequence[str], ident: str, *, reps: int, seed: int | str
) -> DataFrame:
    """``(groups, rep, ident, times)``: how often each replicate draws each member of its group.

    ``members`` has one row per ``(groups, ident)``. Each group of ``k`` members is drawn ``k``
    times with replacement per replicate; members never drawn have no row.
    """
    placed = shuffled_positions(
        members.select(*groups, ident), groups, [ident], seed, "_place"
    )
    if groups:
        sizes = placed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_k"))
        sized = placed.join(sizes, list(groups))
    else:
        sized = placed.withColumn("_k", placed.agg(F.count(F.lit(1)).alias("k")).scalar())
    slots = sized.select(
        *groups, "_k", "_place", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")
    )
    hits = slots.select(
        *groups,
        "rep",
        (draw(seed, *[F.col(g) for g in groups], F.col("rep"), F.col("_place")) % F.col("_k") + 1).alias(
            "_place"
        ),
    )
    return (
        hits.groupBy(*groups, "rep", "_place")
        .agg(F.count(F.lit(1)).alias("times"))
        .join(placed, [*groups, "_place"])
        .select(*groups, "rep", ident, "times")
    )


def replicate_sums(
    counts: DataFrame,
    stats: DataFrame,
    on: Sequence[str],
    by: Sequence[str],
    sums: Sequence[str],
) -> DataFrame:
    """Weighted sums per replicate. Symbols without statistics add nothing, like zero rows.

    Every group has every replicate: one that draws no symbol with statistics has sums of zero.
    """
    drawn = (
        counts.join(stats, list(on))
        .groupBy(*by, "rep")
        .agg(*[F.sum(F.col("times") * F.col(s)).alias(s) for s in sums])
    )
    last = counts.agg(F.max("rep").alias("last"))
    if by:
        every = stats.select(*by).distinct().withColumn("last", last.scalar())
    else:
        every = last
    every = every.select(*by, F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("rep"))
    return every.join(drawn, [*by, "rep"], "left").select(
        *by, "rep", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in sums]
    )


def r2_of_sums(n: str = "n", sy: str = "sy", syy: str = "syy", sse: str = "sse") -> Column:
    total = F.col(syy) - ratio(F.col(sy) * F.col(sy), F.col(n))
    return F.when(total > 0, 1.0 - F.col(sse) / total)


def interval(reps: DataFrame, by: Sequence[str], value: Column, bounds: dict[str, float]) -> DataFrame:
    """Percentiles of a replicate statistic; a group holds at most one row per replicate."""
    return reps.groupBy(*by).agg(
        *[F.percentile(value, p).alias(n) for n, p in bounds.items()],
        F.count_if(value.isNull()).alias("null_reps"),
    )


def ratio_interval(
    counts: DataFrame,
    stats: DataFrame,
    ident: str,
    by: Sequence[str],
    num: str,
    den: str,
    bounds: dict[str, float],
) -> DataFrame:
    reps = replicate_sums(counts, stats, [ident], by, [num, den])
    return interval(reps, by, ratio_if_positive(F.col(num), F.col(den)), bounds)


# --- many replicates over few members ------------------------------------------

MATRIX_CELLS = 16_000_000  # sums that a task holds at a time; more arms go in further rounds


def drawn_sums(
    members: DataFrame,
    stats: DataFrame,
    ident: str,
    by: Sequence[str],
    sums: Sequence[str],
    *,
    reps: int,
    seed: int | str,
    groups: Sequence[str] = (),
) -> DataFrame:
    """``by, rep`` and the weighted ``sums`` of each replicate: those of ``draw_counts`` and ``replicate_sums``, without their rows.

    The sums of all arms are one matrix over the members, as many numbers as ``stats`` has rows. A task draws its
    replicates itself, counts them and multiplies, so no (replicate, member) pair is ever a row, and the arms of a
    replicate share its draws. Members without statistics add nothing. ``groups``, part of ``by``, are drawn
    each from its own members.
    """
    spark = stats.sparkSession
    by, groups = list(by), list(groups)
    shape = ", ".join([*[f"{c} {stats.schema[c].dataType.simpleString()}" for c in by], "rep long", *[f"{s} double" for s in sums]])
    placed = cut_lineage(shuffled_positions(members.select(*groups, ident).distinct(), groups, [ident], seed, "_place"))
    if groups:
        sizes = {tuple(r[g] for g in groups): r["n"] for r in placed.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).collect()}
    else:
        sizes = {(): placed.count()}
    rows = stats.join(placed, [*groups, ident]).select(*by, "_place", *[F.col(s).cast("double").alias(s) for s in sums]).toArrow().to_pandas()
    # What a round holds: for each group its key, its size, some of its arms and their matrix.
    rounds, held, cells = [], [], 0
    arms_of = rows.groupby(by, sort=False, dropna=False) if by else [((), rows)]
    for group, k in sizes.items():
        if not k:
            continue
        own = [(arm, part) for arm, part in ((a if isinstance(a, tuple) else (a,), p) for a, p in arms_of) if tuple(arm[by.index(g)] for g in groups) == group]
        at_once = max(1, MATRIX_CELLS // (k * len(sums)))
        for lo in range(0, len(own), at_once):
            some = own[lo : lo + at_once]
            matrix = np.zeros((k, len(some), len(sums)))
            for i, (_, part) in enumerate(some):
                matrix[part["_place"].to_numpy() - 1, i] = part[list(sums)].to_numpy()
            if held and cells + matrix.size > MATRIX_CELLS:
                rounds, held, cells = [*rounds, held], [], 0
            # A missing arm comes out of the grouping as NaN, whatever its type.
            held.append(([seed, *group], k, [tuple(None if v != v else v for v in arm) for arm, _ in some], matrix))
            cells += matrix.size
    made = None
    for units in [*rounds, held]:
        if units:
            part = _drawn_round(spark, units, by, sums, reps, shape)
            made = part if made is None else made.unionByName(part)
    return spark.createDataFrame([], shape) if made is None else made


def _drawn_round(spark, units: list[tuple], by: list[str], sums: Sequence[str], reps: int, shape: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(units)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for unit, slots in batch.groupby(batch["slot"] // reps):
                keys, k, arms, matrix = shared.value[unit]
                flat, own = matrix.reshape(k, -1), (slots["slot"] % reps).to_numpy()
                totals = np.empty((len(own), len(arms), len(sums)))
                for i, rep in enumerate(own.tolist()):
                    drawn = draws_upto(k, *keys, rep) % np.uint32(k)
                    totals[i] = (np.bincount(drawn, minlength=k) @ flat).reshape(len(arms), len(sums))
                out = {c: [arm[j] for arm in arms] * len(own) for j, c in enumerate(by)} | {"rep": np.repeat(own, len(arms))}
                yield pd.DataFrame(out | {s: totals[:, :, j].ravel() for j, s in enumerate(sums)})

    slots = spark.range(0, reps * len(units), 1, max(1, min(reps, 4 * spark.sparkContext.defaultParallelism)))
    return slots.withColumnRenamed("id", "slot").mapInPandas(run, shape)


# --- draws in packs, by blocks of members ---------------------------------------

PACKED_REPS = 256  # replicates of a block whose given counts one task packs


def packed_draws(spark: SparkSession, members: int, width: int, *, reps: int, seed: int | str) -> DataFrame:
    """``rep, _block, times``: the counts of ``draw_counts`` for ``width`` places each, as unsigned numbers of one size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rep in batch["rep"].tolist():
                drawn = np.bincount(draws_upto(members, seed, rep) % np.uint32(members), minlength=-(-members // width) * width)
                yield pd.DataFrame({"rep": rep, "_block": range(len(drawn) // width), "times": [_packed(t) for t in drawn.reshape(-1, width)]})

    slots = spark.range(0, reps if members else 0, 1, max(1, min(reps, 4 * spark.sparkContext.defaultParallelism)))
    return slots.withColumnRenamed("id", "rep").mapInPandas(run, "rep long, _block int, times binary")


def packed_counts(counts: DataFrame, places: DataFrame, ident: str, width: int) -> DataFrame:
    """Given ``rep, ident, times`` packed likewise; ``places`` numbers the members from 1."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        reps, at = np.unique(part["rep"], return_inverse=True)
        drawn = np.zeros((len(reps), width), np.int64)
        drawn[at, part["_spot"]] = part["times"]
        return pd.DataFrame({"rep": reps, "_block": key[0], "times": [_packed(t) for t in drawn]})

    spot = F.col("_place") - 1
    placed = counts.join(places, ident).select(
        F.floor(spot / width).cast("int").alias("_block"), F.floor(F.col("rep") / PACKED_REPS).alias("_reps"), (spot % width).alias("_spot"), "rep", "times"
    )
    return placed.groupBy("_block", "_reps").applyInPandas(run, "rep long, _block int, times binary")


def _packed(times: np.ndarray) -> bytes:
    return times.astype(np.min_scalar_type(int(times.max()))).tobytes()


def unpacked(slots: pd.Series, packs: pd.Series, width: int, reps: int) -> np.ndarray:
    """(width, reps): the counts of a block; replicates without a pack drew none of it."""
    read = [np.frombuffer(p, f"<u{len(p) // width}") for p in packs]
    out = np.zeros((reps, width), max([r.dtype for r in read], default=np.dtype(np.uint8)))
    for slot, times in zip(slots, read):
        out[slot] = times
    return np.ascontiguousarray(out.T)


def array_percentile(ordered: Column, p: float) -> Column:
    """Interpolated percentile of a sorted array; NULL if it is empty."""
    at = (F.size(ordered) - 1) * F.lit(float(p))
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return F.when(F.size(ordered) > 0, low + (high - low) * (at - F.floor(at)))


def all_differences(reps: DataFrame, arm: str, by: Sequence[str], value: Column, bounds: dict[str, float]) -> DataFrame:
    """``by, arm, other`` and an interval of ``value(arm) - value(other)`` for every ordered pair of arms on shared draws.

    Each arm's replicates are one array in replicate order, so a pair of arms is one row and not one per
    replicate. A replicate in which either side is missing counts in ``null_reps``.
    """
    by = list(by)
    if not by:  # one group of all
        return all_differences(reps.withColumn("_all", F.lit(0)), arm, ["_all"], value, bounds).drop("_all")
    arrays = reps.groupBy(*by, arm).agg(F.sort_array(F.collect_list(F.struct("rep", value.alias("v")))).alias("_r")).select(
        *by, arm, F.transform("_r", lambda r: r["v"]).alias("_v")
    )
    left, right = arrays, arrays.select(*by, F.col(arm).alias("other"), F.col("_v").alias("_o"))
    gaps = left.join(right, by).filter(F.col(arm) != F.col("other")).select(*by, arm, "other", F.zip_with("_v", "_o", lambda a, b: a - b).alias("_d"))
    known = F.array_sort(F.filter("_d", lambda d: d.isNotNull()))
    kept = gaps.select(*by, arm, "other", F.size("_d").alias("_n"), known.alias("_k"))
    return kept.select(
        *by, arm, "other", *[array_percentile(F.col("_k"), p).alias(n) for n, p in bounds.items()],
        (F.col("_n") - F.size("_k")).cast("long").alias("null_reps"),
    )
