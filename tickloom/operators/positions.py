"""Row positions inside a group without handing the group to one task.

``row_number() OVER (PARTITION BY key ORDER BY ...)`` sorts a whole key in one task.
Here a key is first cut into pieces that are consecutive in the wanted order, the
pieces are counted (a small aggregate), and a row's position is the size of all
earlier pieces plus its place in its own piece.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.draws import draw, draw_bucket

HASH_PIECES = 4_096  # at least; more where the job is set to more partitions
SAMPLES_PER_PIECE = 32
WHOLE_ROWS = 65_536  # groups of at most so many rows are ordered in one piece each


def piece_offsets(df: DataFrame, keys: Sequence[str], piece: str) -> DataFrame:
    """``keys, piece, _offset``: rows of ``keys`` in the pieces before."""
    sizes = df.groupBy(*keys, piece).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *keys, piece, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )


def positions_by_piece(
    df: DataFrame,
    keys: Sequence[str],
    piece: Column,
    order: Sequence[str | Column],
    out: str,
    at_most: int | None = None,
) -> DataFrame:
    """1-based position of each row in ``order`` within ``keys``.

    ``piece`` must not decrease along ``order``. ``at_most`` keeps only the first rows of
    each key; pieces that lie entirely behind it are dropped before the shuffle.
    """
    cut = df.withColumn("_piece", piece)
    offsets = piece_offsets(cut, keys, "_piece")
    if at_most is not None:
        offsets = offsets.filter(F.col("_offset") < at_most)
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order)
    placed = cut.join(offsets, [*keys, "_piece"]).withColumn(
        out, (F.row_number().over(inside) + F.col("_offset")).cast("bigint")
    )
    if at_most is not None:
        placed = placed.filter(F.col(out) <= at_most)
    return placed.drop("_piece", "_offset")


def shuffled_positions(
    df: DataFrame,
    keys: Sequence[str],
    ident: Sequence[str],
    seed: int | str,
    out: str,
    at_most: int | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """1-based position of each row in a seeded random order within ``keys``.

    The order is by draw, then by ``ident``; equal slices of the draw range are the pieces.
    """
    drawn = df.withColumn("_draw", draw(seed, *[F.col(c) for c in ident]))
    if pieces is None:
        pieces = max(HASH_PIECES, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else None
        if keys and (largest or 0) <= WHOLE_ROWS:
            # Pieces of small groups would be as many as the rows.
            inside = Window.partitionBy(*keys).orderBy("_draw", *ident)
            placed = drawn.withColumn(out, F.row_number().over(inside).cast("bigint")).drop("_draw")
            return placed if at_most is None else placed.filter(F.col(out) <= at_most)
    placed = positions_by_piece(
        drawn, keys, draw_bucket(F.col("_draw"), pieces), ["_draw", *ident], out, at_most
    )
    return placed.drop("_draw")


def range_piece(df: DataFrame, order: Sequence[Column], pieces: int) -> Column:
    """Number of the range that a row of ``df`` falls into along ``order`` (ascending, NULL first).

    The cuts come from a bounded sample chosen by the hash of the order columns, which is all that one small job
    reads; they are constants of the plan, so every evaluation uses the same ones. A row compares itself
    with about ``2 * sqrt(pieces)`` of them. Rows that tie on all of ``order`` share a range.
    """
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    sample = df.select(place.alias("t")).orderBy(F.xxhash64("t"), "t").limit(SAMPLES_PER_PIECE * pieces)
    ordered = sample.agg(F.sort_array(F.collect_list("t")).alias("s")).filter(F.size("s") > 0)
    spots = F.transform(
        F.sequence(F.lit(1), F.lit(max(pieces - 1, 1))), lambda i: F.get("s", F.floor(i * F.size("s") / pieces).cast("int"))
    )
    cuts = ordered.select(spots.alias("cuts"))
    found = cuts.select(F.to_json("cuts")).first()
    if found is None:
        return F.lit(0)
    kind = cuts.schema["cuts"].dataType
    step = math.isqrt(pieces) + 1

    def constant(chosen: list) -> Column:
        return F.from_json(F.lit(json.dumps(chosen)), kind)

    # What the text rounds is the same for all rows, and the cuts stay in order.
    all_cuts = json.loads(found[0])
    passed = F.size(F.filter(constant(all_cuts[step - 1 :: step]), lambda c: c <= place)) * step
    return (passed + F.size(F.filter(F.slice(constant(all_cuts), passed + 1, step), lambda c: c <= place))).cast("int")


def even_pieces(df: DataFrame) -> int:
    """More pieces than partitions, so that hashing deals them out evenly."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sorted_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    pieces: int | None = None,
) -> DataFrame:
    """1-based position by arbitrary values, for orders with no known distribution.

    ``order`` is ascending; negate a number to have it fall. The rows are shuffled once, by range; the cuts and
    the counts per range read only the keys and order columns, so an input that is costly to compute
    is better staged before.
    """
    count = pieces or even_pieces(df)
    return positions_by_piece(df, keys, range_piece(df, [*[F.col(k) for k in keys], *order], count), order, out)


def sorted_running_total(
    df: DataFrame, order: Sequence[Column], weight: str, out: str, pieces: int | None = None
) -> DataFrame:
    """Running sum of ``weight`` along a global order, current row included."""
    count = pieces or even_pieces(df)
    ranged = df.withColumn("_range", range_piece(df, order, count))
    sums = ranged.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    # One row per range: as many as the job has partitions.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(offsets, "_range")
        .withColumn(out, F.sum(weight).over(inside) + F.col("_offset"))
        .drop("_range", "_offset")
    )


def tile(position: Column, total: Column, tiles: int) -> Column:
    """0-based tile of a 1-based position; the first ``total % tiles`` tiles get one more row."""
    zero = position - 1
    small = F.floor(total / tiles)
    larger = total % tiles
    head = larger * (small + 1)
    in_head = F.floor(zero / (small + 1))
    in_tail = larger + F.floor(F.try_divide(zero - head, small))
    return F.when(zero < head, in_head).otherwise(in_tail).cast("bigint")
