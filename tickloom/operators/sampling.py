"""Seeded samples, splits and permutations, all driven by keyed draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.draws import uniform
from tickloom.operators.positions import shuffled_positions
from tickloom.operators.quantiles import grouped_quantiles


def sample_rows(df: DataFrame, ident: Sequence[str], n: int, seed: int | str) -> DataFrame:
    """``n`` rows without replacement; all rows when there are fewer. No global sort."""
    return shuffled_positions(df, [], ident, seed, "_place", at_most=n).drop("_place")


def _sized(df: DataFrame, groups: Sequence[str], ident: str, seed: int | str) -> DataFrame:
    placed = shuffled_positions(df, groups, [ident], seed, "_place")
    sizes = placed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(sizes, list(groups))


def stratified_split(
    members: DataFrame, stratum: str, ident: str, seed: int | str, fit_fraction: float = 2 / 3
) -> DataFrame:
    """Add ``role`` fit/select per stratum. A single member fits; at least one always fits."""
    n = F.col("_n")
    wanted = F.greatest(F.lit(1), F.bround(n * (1.0 - fit_fraction)).cast("bigint"))
    selected = F.when(n < 2, 0).otherwise(F.least(wanted, n - 1))
    role = F.when(F.col("_place") <= selected, "select").otherwise("fit")
    return _sized(members, [stratum], ident, seed).withColumn("role", role).drop("_place", "_n")


def three_way_split(
    members: DataFrame,
    stratum: str,
    ident: str,
    *,
    reference_per_stratum: int,
    distill_per_stratum: int,
    seed: int | str,
    split_seed: int | str,
) -> DataFrame:
    """Reference, then fit and select from the rest; the first members by id are candidates."""
    from tickloom.operators.ranking import first_per_group

    candidates = first_per_group(
        members, [stratum], [F.col(ident)], reference_per_stratum + distill_per_stratum
    )
    placed = shuffled_positions(candidates, [stratum], [ident], seed, "_place")
    reference = placed.filter(F.col("_place") <= reference_per_stratum).drop("_place")
    rest = placed.filter(F.col("_place") > reference_per_stratum).drop("_place")
    split = stratified_split(rest, stratum, ident, split_seed)
    return reference.withColumn("role", F.lit("reference")).unionByName(split)


def group_split(
    members: DataFrame, group: str, ident: str, seed: int | str, parts: int = 6
) -> DataFrame:
    """Per group one part evaluates, one part selects, the rest trains."""
    share = F.floor(F.col("_n") / parts)
    role = (
        F.when(F.col("_place") <= share, "eval")
        .when(F.col("_place") <= 2 * share, "select")
        .otherwise("train")
    )
    return _sized(members, [group], ident, seed).withColumn("role", role).drop("_place", "_n")


def assign_sets(rows: DataFrame, split: DataFrame, ident: str, date: str, rules: DataFrame) -> DataFrame:
    """Rows to named sets: ``rules`` lists which role on which date forms which set."""
    return rows.join(split.select(ident, "role"), ident).join(rules, ["role", date])


def permute_within(
    df: DataFrame, groups: Sequence[str], position: str, value: str, seed: int | str, out: str
) -> DataFrame:
    """Give every row the value of another row of its group, by a seeded permutation.

    ``position`` is the dense 1-based place of the row in its group (over all rows when
    ``groups`` is empty).
    """
    donors = shuffled_positions(
        df.select(*groups, position, F.col(value).alias(out)), groups, [*groups, position], seed, "_place"
    ).select(*groups, F.col("_place").alias(position), out)
    return df.join(donors, [*groups, position])


def fold_assignments(
    members: DataFrame, ident: str, *, folds: int, repeats: int, seed: int | str
) -> DataFrame:
    """``(rep, ident, fold)``: each repeat deals the shuffled members into folds in turn."""
    repeated = members.select(ident).distinct().select(
        ident, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")
    )
    placed = shuffled_positions(repeated, ["rep"], ["rep", ident], seed, "_place")
    return placed.select("rep", ident, ((F.col("_place") - 1) % folds).alias("fold"))


def uniform_box(
    df: DataFrame, columns: Sequence[str], n: int, seed: int | str, tail: float = 0.01
) -> DataFrame:
    """``n`` rows of independent uniform draws between the tail quantiles of each column.

    The bounds of all columns are one grouped job; two numbers per column reach the driver.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "_column", "_value")
    cuts = grouped_quantiles(long, ["_column"], "_value", {"lo": tail, "hi": 1.0 - tail}).collect()
    box = {r["_column"]: (r["lo"], r["hi"]) for r in cuts}
    return df.sparkSession.range(n).select(
        F.col("id").alias("draw_id"),
        *[
            (F.lit(lo) + (F.lit(hi) - F.lit(lo)) * uniform(seed, F.lit(c), F.col("id"))).alias(c)
            for c in columns
            for lo, hi in [box.get(c, (None, None))]
        ],
    )
