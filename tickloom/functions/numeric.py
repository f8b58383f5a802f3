"""Arithmetic with the missing-value policy of the library: not observed is NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den``; NULL when the denominator is zero or either side is missing."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_if_positive(num: Column, den: Column) -> Column:
    return F.when(den > 0, ratio(num, den))


def finite(col: Column) -> Column:
    """NaN and infinities become NULL, so aggregates skip them."""
    value = col.cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)  # NaN sorts above infinity


def positive(col: Column) -> Column:
    """A price that cannot be traded at (zero, negative, not finite) is missing."""
    value = finite(col)
    return F.when(value > 0, value)


def root(col: Column) -> Column:
    return F.when(col >= 0, F.sqrt(col))


def clip(col: Column, low: Column, high: Column) -> Column:
    """Clamp to ``[low, high]`` and keep NULL as NULL (``least`` alone would not)."""
    return F.when(col.isNotNull(), F.greatest(F.least(col, high), low))


def nulls_for_nonfinite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep rows where every listed column is a finite number."""
    return complete(nulls_for_nonfinite(df, columns), columns)


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every listed number is there and not NaN.

    A conjunction of one condition per column: the single one over all of them that ``na.drop`` makes takes the
    optimizer exponential time where the columns are then renamed.
    """
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]
    return df.filter(reduce(lambda a, b: a & b, known)) if known else df
