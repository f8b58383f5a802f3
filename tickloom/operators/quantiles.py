"""Exact grouped quantiles whose memory does not grow with the group.

The built-in exact ``percentile`` keeps every distinct value of a group in one task. Here
a mergeable sketch brackets each wanted rank, a second pass counts the distinct values
inside the brackets only (everything outside collapses to one counter per gap), and the
exact order statistics are read from running counts. Groups are counted first: when none is
larger than the sketch accuracy, plain ranks within each group are enough.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import broadcast_if_small, cut_lineage

ACCURACY = 10_000
FINE_SLICES = 1_024


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    how: str = "linear",
    accuracy: int = ACCURACY,
    count_as: str | None = None,
) -> DataFrame:
    """One row per key with a column per entry of ``probs``; NULL and NaN values are skipped.

    ``how`` is ``linear`` (interpolated), ``lower`` or ``higher``.
    """
    names = sorted(probs, key=lambda n: probs[n])
    ranks = [probs[n] for n in names]
    count = len(names)
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    size = F.count(F.lit(1)).alias("_n")
    margin = 2.0 / accuracy
    lows = [max(p - margin, 0.0) for p in ranks]
    highs = [min(p + margin, 1.0) for p in ranks]
    sketch = F.percentile_approx("_v", [*lows, *highs], accuracy).alias("_sketch")

    if keys:
        busy = cut_lineage(
            data.groupBy(*keys).agg(size).filter(F.col("_n") > accuracy).select(*keys)
        )
        if busy.isEmpty():
            return _picked(_ranked_small(data, keys), keys, names, ranks, how, count_as, list(probs))
        # Only groups too large for one task need the sketch; the others are ranked as they are.
        busy = broadcast_if_small(busy)
        small = _picked(
            _ranked_small(data.join(busy, list(keys), "left_anti"), keys),
            keys, names, ranks, how, count_as, list(probs),
        )
        data = data.join(busy, list(keys), "left_semi")
        summary = data.groupBy(*keys).agg(size, sketch)
    else:
        summary = data.agg(size, sketch)
    summary = summary.select(
        *keys,
        "_n",
        F.slice("_sketch", 1, count).alias("_lows"),
        F.slice("_sketch", count + 1, count).alias("_highs"),
    )

    # The brackets are one short row per key. They are staged to be read once and counted.
    if keys:
        joined = data.join(broadcast_if_small(cut_lineage(summary)), list(keys))
    else:
        row = summary.first()
        if not row["_n"]:
            return _nothing(df, count_as, list(probs))
        if row["_n"] <= accuracy:
            return _picked(_ranked_small(data, keys), keys, names, ranks, how, count_as, list(probs))
        joined = data.select(
            "_v",
            F.lit(row["_n"]).cast("bigint").alias("_n"),
            F.array(*[F.lit(x) for x in row["_lows"]]).alias("_lows"),
            F.array(*[F.lit(x) for x in row["_highs"]]).alias("_highs"),
        )

    # Both ends of the brackets rise with the rank: a value lies in a bracket exactly when it is
    # not above the end of the last bracket that starts at or below it.
    slot = F.expr(" + ".join(f"CAST(_v >= _lows[{i}] AS INT)" for i in range(count)))
    low, high = F.expr("_lows[_slot - 1]"), F.expr("_highs[_slot - 1]")
    inside = (F.col("_slot") > 0) & (F.col("_v") <= F.get("_highs", F.greatest(F.col("_slot") - 1, F.lit(0))))
    fine = F.width_bucket(F.col("_v"), low, high, F.lit(FINE_SLICES))
    counted = cut_lineage(
        joined.withColumn("_slot", slot)
        .withColumn("_in", inside)
        .select(
            *keys,
            "_slot",
            "_n",
            F.when(F.col("_in"), F.coalesce(fine, F.lit(1))).otherwise(F.lit(FINE_SLICES + 2)).alias("_fine"),
            F.when(F.col("_in"), F.col("_v")).alias("_at"),
        )
        .groupBy(*keys, "_slot", "_fine", "_at")
        .agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    )
    piece = [*keys, "_slot", "_fine"]
    sizes = counted.groupBy(*piece).agg(F.sum("_c").alias("_size"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_slot", "_fine").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *piece, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*piece).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(offsets, piece).withColumn(
        "_upto", F.sum("_c").over(within) + F.col("_offset")
    )

    picked = _picked(ranked, keys, names, ranks, how, count_as, list(probs))
    return picked.unionByName(small) if keys else picked


def _ranked_small(data: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every value with its rank, for groups known to fit one task."""
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return data.select(
        *keys,
        F.col("_v").alias("_at"),
        F.row_number().over(group.orderBy("_v")).alias("_upto"),
        F.count(F.lit(1)).over(group).alias("_n"),
    )


def _picked(
    ranked: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    ranks: Sequence[float],
    how: str,
    count_as: str | None,
    order: Sequence[str],
) -> DataFrame:
    """Read the wanted order statistics off running counts ``_upto``."""
    picks = ["max(_n) AS _n"]
    for i, p in enumerate(ranks):
        place = f"(_n - 1) * {float(p)!r}D"
        picks.append(f"min(if(_upto > floor({place}), _at, NULL)) AS _a{i}")
        picks.append(f"min(if(_upto > ceil({place}), _at, NULL)) AS _b{i}")
    picked = ranked.groupBy(*keys).agg(*[F.expr(p) for p in picks])

    ordered = {}
    for i, name in enumerate(names):
        place = f"(_n - 1) * {float(ranks[i])!r}D"
        ordered[name] = F.expr(
            {
                "linear": f"_a{i} + (_b{i} - _a{i}) * ({place} - floor({place}))",
                "lower": f"_a{i}",
                "higher": f"_b{i}",
            }[how]
        ).alias(name)
    extra = [F.col("_n").alias(count_as)] if count_as else []
    return picked.select(*keys, *extra, *[ordered[n] for n in order])


def _nothing(df: DataFrame, count_as: str | None, names: Sequence[str]) -> DataFrame:
    fields = ([f"{count_as} bigint"] if count_as else []) + [f"{n} double" for n in names]
    return df.sparkSession.createDataFrame([], ", ".join(fields))


def grouped_medians(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Medians of several columns in one job: the column name becomes part of the key."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "_measure", "_value"
    )
    medians = grouped_quantiles(long, [*keys, "_measure"], "_value", {"_median": 0.5})
    return medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_measure") == c, F.col("_median"))).alias(c) for c in columns]
    )
