"""Window frames over tick sequences, split so that one busy symbol is many tasks.

A bounded frame only needs the rows next to it. A sequence is cut into chunks of
``chunk_rows`` rows (or ``bucket_us`` of clock), the few rows a neighbouring chunk needs
are copied to it, the window runs per chunk, and the copies are dropped again. Results
are the same as with one window per symbol. Unbounded running values are computed per
chunk and combined with one carried value per earlier chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.clock import bucket_of

CHUNK_ROWS = 65_536

Build = Callable[[DataFrame, WindowSpec], DataFrame]


def _chunk(seq: Column, chunk_rows: int) -> Column:
    return F.floor((seq - 1) / F.lit(chunk_rows)).cast("bigint")


def spread_over_chunks(
    df: DataFrame, keys: Sequence[str], seq: str, *, before: int = 0, after: int = 0, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Rows with ``_home``, their own chunk, and ``_chunk``, once for each chunk that has to see them."""
    position = F.col(seq)
    first = _chunk(F.greatest(position - after, F.lit(1)), chunk_rows)
    last = _chunk(position + before, chunk_rows)
    return df.withColumn("_home", _chunk(position, chunk_rows)).withColumn("_chunk", F.explode(F.sequence(first, last)))


def over_rows(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    build: Build,
    *,
    before: int = 0,
    after: int = 0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Run ``build(df, window)`` where every row sees ``before`` earlier and ``after`` later rows.

    ``seq`` is the dense 1-based position in ``keys``. For nested frames ``before`` and
    ``after`` are the sums along the nesting.
    """
    spread = spread_over_chunks(df, keys, seq, before=before, after=after, chunk_rows=chunk_rows)
    window = Window.partitionBy(*keys, "_chunk").orderBy(seq)
    return build(spread, window).filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


def over_clock(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    seq: str,
    build: Build,
    *,
    before_us: int = 0,
    after_us: int = 0,
    bucket_us: int,
) -> DataFrame:
    """Like :func:`over_rows` with the neighbourhood given in microseconds."""
    at = F.col(time)
    spread = df.withColumn("_home", bucket_of(at, bucket_us)).withColumn(
        "_chunk",
        F.explode(F.sequence(bucket_of(at - after_us, bucket_us), bucket_of(at + before_us, bucket_us))),
    )
    window = Window.partitionBy(*keys, "_chunk").orderBy(time)
    return build(spread, window).filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    values: dict[str, Column],
    *,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Cumulative sums from the start of each key, current row included."""
    staged = df.withColumn("_chunk", _chunk(F.col(seq), chunk_rows)).withColumns(
        {f"_v_{name}": value for name, value in values.items()}
    )
    totals = staged.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in values]
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in values],
    )
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = staged.join(carried, [*keys, "_chunk"])
    out = joined.withColumns(
        {n: F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) + F.col(f"_c_{n}") for n in values}
    )
    return out.drop("_chunk", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def forward_fill(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    columns: Sequence[str],
    *,
    default: float | None = None,
    suffix: str = "",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Last observed value at or before each row, never a later one; ``default`` before the first."""
    staged = df.withColumn("_chunk", _chunk(F.col(seq), chunk_rows))
    latest = staged.groupBy(*keys, "_chunk").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_l_{c}")
            for c in columns
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(
        *keys, "_chunk", *[F.last(f"_l_{c}", True).over(earlier).alias(f"_c_{c}") for c in columns]
    )
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = staged.join(carried, [*keys, "_chunk"])
    filled = {}
    for c in columns:
        options = [F.last(c, True).over(inside), F.col(f"_c_{c}")]
        if default is not None:
            options.append(F.lit(default))
        filled[f"{c}{suffix}"] = F.coalesce(*options)
    return joined.withColumns(filled).drop("_chunk", *[f"_c_{c}" for c in columns])
