"""Causal windows, signals and conditions along tick sequences."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.frames import CHUNK_ROWS, forward_fill, over_rows, running_total
from tickloom.operators.kernels import Stretch, over_chunks, prior_order_statistics

MIN_GAP_SECONDS = 1e-6


def with_rolling_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    cuts: Mapping[str, Mapping[str, float]],
    size: int = 100,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Quantiles of the ``size`` rows before each row, upper neighbour, for several columns in one pass.

    ``cuts`` maps a column to new names and their probabilities. NULL until ``size`` rows precede and
    while any of them is missing. Each column keeps one sorted window per chunk, however many
    quantiles are read from it.
    """
    places = {value: {name: math.ceil(p * (size - 1)) for name, p in probs.items()} for value, probs in cuts.items()}

    def kernel(rows: Stretch) -> dict:
        out = {}
        for value, wanted in places.items():
            out |= prior_order_statistics(rows.floats(value), rows.starts, size, wanted)
        return out

    outputs = {name: T.DoubleType() for probs in cuts.values() for name in probs}
    return over_chunks(df, keys, seq, kernel, outputs, before=size, chunk_rows=chunk_rows)


def with_prior_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    value: str,
    probs: Mapping[str, float],
    size: int = 100,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """:func:`with_rolling_quantiles` of one column."""
    return with_rolling_quantiles(df, keys, seq, {value: probs}, size, chunk_rows)


def signal_rules(score: str, cuts: Sequence[str], outcome: Column | None = None) -> dict[str, Column]:
    """``sig_all``, ``sig_abs`` (score above zero) and one signal per cut (score above the cut)."""
    known = F.col(score).isNotNull()
    if outcome is not None:
        known = known & outcome.isNotNull()
    out = {"sig_all": known, "sig_abs": known & F.coalesce(F.col(score) > 0, F.lit(False))}
    for cut in cuts:
        out[f"sig_{cut}"] = known & F.coalesce(F.col(score) > F.col(cut), F.lit(False))
    return out


def run_ids(
    df: DataFrame, keys: Sequence[str], seq: str, value: str, out: str = "run_id", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """0-based number of the run of equal consecutive values."""

    def mark(d: DataFrame, w: WindowSpec) -> DataFrame:
        same = F.col(value).eqNullSafe(F.lag(value, 1).over(w))
        return d.withColumn("_changed", ((F.col(seq) > 1) & ~same).cast("bigint"))

    marked = over_rows(df, keys, seq, mark, before=1, chunk_rows=chunk_rows)
    return running_total(marked, keys, seq, {out: F.col("_changed")}, chunk_rows=chunk_rows).drop("_changed")


def causal_windows(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    features: Sequence[str],
    *,
    size: int = 16,
    out: str = "window",
    fill: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Flat array of the last ``size`` rows of ``features``, oldest first.

    Missing values take the last earlier value of the session (0.0 before the first); a short
    history is padded by repeating the session's first row.
    """
    staged = df.withColumns({f"_f_{f}": F.col(f) for f in features})
    columns = [f"_f_{f}" for f in features]
    if fill:
        staged = forward_fill(staged, keys, seq, columns, default=0.0, chunk_rows=chunk_rows)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        recent = F.collect_list(F.array(*columns)).over(w.rowsBetween(-(size - 1), 0))
        padded = F.concat(F.array_repeat(F.element_at(recent, 1), size - F.size(recent)), recent)
        return d.withColumn(out, F.flatten(padded))

    return over_rows(staged, keys, seq, build, before=size - 1, chunk_rows=chunk_rows).drop(*columns)


def sampled_causal_windows(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    features: Sequence[str],
    sampled: Column,
    *,
    size: int = 16,
    out: str = "window",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """:func:`causal_windows` for sampled rows only; other columns are pruned first and the
    wide array lives only as long as a row batch."""
    lean = df.select(*keys, seq, *features, sampled.alias("_sampled"))
    full = causal_windows(lean, keys, seq, features, size=size, out=out, chunk_rows=chunk_rows)
    return full.filter("_sampled").drop("_sampled")


def crossover(value: Column, threshold: Column, window: WindowSpec) -> Column:
    """True where ``value`` moves from at or below ``threshold`` to above it."""
    above = value > threshold
    return above & F.coalesce(~F.lag(above, 1).over(window), F.lit(False))


def persistence(condition: Column, window: WindowSpec, ticks: int) -> Column:
    """True where the condition held on this and the ``ticks - 1`` rows before."""
    held = F.count_if(condition).over(window.rowsBetween(-(ticks - 1), 0))
    return held == ticks


def sequence_within(first: Column, then: Column, window: WindowSpec, ticks: int) -> Column:
    """True where ``then`` holds and ``first`` held on one of the ``ticks`` rows before."""
    return then & (F.count_if(first).over(window.rowsBetween(-ticks, -1)) > 0)
