"""As-of and interval operators on tick sequences.

Spark has no as-of join in the DataFrame API. Probes and ticks are laid on one clock, cut
into buckets, and the first tick after a gap is also laid into the buckets that look across
it, so no symbol has to be read as a whole by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.clock import bucket_of
from tickloom.operators.frames import CHUNK_ROWS, over_clock, over_rows
from tickloom.operators.kernels import Stretch, last_in_time, over_chunks, window_minima


def forward_asof(
    ticks: DataFrame,
    keys: Sequence[str],
    time: str,
    seq: str,
    *,
    horizon_us: int,
    take: dict[str, str],
    bucket_us: int,
    keep: Sequence[str] | None = None,
    previous: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """For each tick at ``t`` the first tick of the same key with time ``>= t + horizon_us``.

    ``take`` maps new column names to columns of the found tick; they are NULL when the day
    ends first. Equal times resolve to the lowest ``seq``. The result has ``keep`` (all columns by
    default) and the found values; name few, for they travel.

    The ticks are read once. A row becomes a tick in the bucket of its time and a probe in the bucket of
    its horizon; the first tick after a gap is also laid into the buckets before it that probes can fall
    into, so no bucket has to look into another. ``previous`` names a column with the time of the tick
    before, where the caller has it; else one narrow pass makes it.
    """
    kept = list(ticks.columns) if keep is None else list(dict.fromkeys([*keys, *keep]))
    lean = ticks.select(*dict.fromkeys([*keys, seq, time, *kept, *take.values(), *([previous] if previous else [])]))
    if previous is None:
        previous = "_previous"
        lean = over_rows(
            lean, keys, seq, lambda d, w: d.withColumn(previous, F.lag(time, 1).over(w)), before=1, chunk_rows=chunk_rows
        )
    at, before = F.col(time), F.col(previous)
    own, last = bucket_of(at, bucket_us), bucket_of(before, bucket_us)
    gap_end = F.least(own - 1, bucket_of(before + horizon_us, bucket_us))

    def entry(bucket: Column, clock: Column, probe: bool) -> Column:
        return F.struct(bucket.alias("bucket"), clock.alias("clock"), F.lit(probe).alias("probe"))

    gap = F.when(last <= gap_end, F.transform(F.sequence(last, gap_end), lambda b: entry(b, at, False)))
    places = F.array(entry(own, at, False), entry(bucket_of(at + horizon_us, bucket_us), at + horizon_us, True))
    laid = lean.select("*", F.explode(F.concat(places, F.coalesce(gap, F.array().cast(_ENTRIES)))).alias("_at")).select(
        *keys,
        F.col("_at.bucket").alias("_bucket"),
        F.col("_at.clock").alias("_clock"),
        F.col("_at.probe").alias("_probe"),
        F.col(seq).alias("_order"),
        F.when(~F.col("_at.probe"), F.struct(F.lit(True).alias("_seen"), *[F.col(c).alias(n) for n, c in take.items()])).alias("_tick"),
        F.when(F.col("_at.probe"), F.struct(*[F.col(c) for c in kept])).alias("_row"),
    )
    # Running backwards in time keeps the frame growing, which Spark evaluates in one pass.
    backwards = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(F.col("_clock").desc(), F.col("_probe").asc(), F.col("_order").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    matched = laid.withColumn("_hit", F.last("_tick", True).over(backwards)).filter("_probe")
    return matched.select("_row.*", *[F.col(f"_hit.{n}").alias(n) for n in take])


_ENTRIES = "array<struct<bucket:bigint,clock:bigint,probe:boolean>>"


def fill_flag(
    ticks: DataFrame,
    keys: Sequence[str],
    time: str,
    seq: str,
    *,
    sell_min: str,
    limit_price: str,
    max_rows: int,
    max_us: int,
    out: str = "y_fill",
    previous: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """1.0 when a later sell print within both bounds trades at or below this row's limit price.

    The window is bounded by rows and by clock at once, which one frame cannot say. Within a chunk its end
    is bisected and its lowest print read from minima over powers of two, so that no row carries an array.
    ``previous`` also gives the time of the tick before, under that name.
    """

    def kernel(rows: Stretch) -> dict[str, np.ndarray]:
        times, prints = rows.ints(time), rows.floats(sell_min)
        last = last_in_time(times, rows.ends, max_rows, max_us)
        best = window_minima(np.where(prints > 0, prints, np.inf), np.arange(len(times)) + 1, last)
        made = {out: (best <= rows.floats(limit_price)).astype(float)}
        if previous:
            made[previous] = pa.array(np.roll(times, 1), mask=np.isin(np.arange(len(times)), rows.starts))
        return made

    outputs = {out: T.DoubleType()} | ({previous: T.LongType()} if previous else {})
    return over_chunks(
        ticks, keys, seq, kernel, outputs, before=1 if previous else 0, after=max_rows, chunk_rows=chunk_rows
    )


def lookback_count(
    ticks: DataFrame,
    keys: Sequence[str],
    time: str,
    seq: str,
    *,
    span_us: int,
    bucket_us: int,
    out: str = "recent_count",
) -> DataFrame:
    """Rows before this one, in sequence order, whose time is at most ``span_us`` earlier."""

    def build(df: DataFrame, window) -> DataFrame:
        by_time = window  # ordered by time: range frames need one numeric order column
        stale = F.count(F.lit(1)).over(
            by_time.rangeBetween(Window.unboundedPreceding, -(span_us + 1))
        )
        ordered = Window.partitionBy(*keys, "_chunk").orderBy(time, seq)
        earlier = F.row_number().over(ordered) - 1
        return df.withColumn(out, (earlier - stale).cast("bigint"))

    return over_clock(
        ticks, keys, time, seq, build, before_us=span_us, bucket_us=bucket_us
    )


def neighbour_gaps(df: DataFrame, window, time: str) -> DataFrame:
    """Seconds since the previous and until the next event, as ``dt_prev`` and ``dt_next``."""
    at: Column = F.col(time)
    return df.withColumns(
        {
            "dt_prev": (at - F.lag(time, 1).over(window)) / 1e6,
            "dt_next": (F.lead(time, 1).over(window) - at) / 1e6,
        }
    )
