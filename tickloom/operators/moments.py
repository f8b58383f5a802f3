"""Means and co-moments about the mean, merged pairwise: no difference of large sums is ever taken.

Each task reduces its rows to one mean vector and one matrix of centred products; two such parts merge exactly as if
their rows had been seen together. A column far from zero keeps its spread, and any number of columns is one
scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import complete, ratio

# A variance below this share of the squared mean is what rounding leaves of a constant column.
CONSTANT = 1e-27


@dataclass
class Moments:
    """Rows, total weight, weighted means, and weighted population covariance."""

    n: int
    weight: float
    mean: np.ndarray
    cov: np.ndarray

    @property
    def sample_cov(self) -> np.ndarray:
        return self.cov * (self.n / (self.n - 1)) if self.n > 1 else np.full_like(self.cov, np.nan)


Part = tuple[int, float, np.ndarray, np.ndarray]


def _merged(parts: Iterable[Part], width: int) -> Part:
    n, weight, mean, products = 0, 0.0, np.zeros(width), np.zeros((width, width))
    for more, heavy, center, about in parts:
        total = weight + heavy
        if heavy > 0:
            gap = center - mean
            products = products + about + np.outer(gap, gap) * (weight * heavy / total)
            mean = mean + gap * (heavy / total)
        n, weight = n + more, total
    return n, weight, mean, products


def _of_block(x: np.ndarray, w: np.ndarray) -> Part:
    heavy = float(w.sum())
    center = (w @ x) / heavy if heavy > 0 else np.zeros(x.shape[1])
    apart = x - center
    return len(x), heavy, center, (apart * w[:, None]).T @ apart


_SHAPE = "n long, weight double, mean array<double>, products array<double>"


def _row(part: Part) -> pa.RecordBatch:
    n, weight, mean, products = part
    return pa.RecordBatch.from_arrays(
        [pa.array([n], pa.int64()), pa.array([weight]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))],
        ["n", "weight", "mean", "products"],
    )


def co_moments(df: DataFrame, columns: Sequence[str], w: str | None = None) -> Moments:
    """Moments of the rows in which all of ``columns`` (and ``w``) are known.

    One part per task is merged by a handful of tasks before ``k * k`` numbers from each reach the driver.
    """
    width = len(columns)
    known = complete(df, [*columns, *([w] if w else [])])
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    lean = known.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], weight.alias("w"))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[Part]:
            for batch in batches:
                if batch.num_rows:
                    yield _of_block(np.column_stack([batch.column(i).to_numpy() for i in range(width)]), batch.column(width).to_numpy())

        yield _row(_merged(blocks(), width))

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        yield _row(_merged(((r["n"], r["weight"], np.array(r["mean"]), np.array(r["products"]).reshape(width, width)) for r in rows), width))

    few = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    parts = lean.mapInArrow(reduced, _SHAPE).repartition(few).mapInArrow(united, _SHAPE).collect()
    found = ((r.n, r.weight, np.array(r["mean"]), np.array(r.products).reshape(width, width)) for r in parts)
    n, total, mean, products = _merged(found, width)
    return Moments(n, total, mean, products / total if total > 0 else np.full((width, width), np.nan))


def weighted_correlations(df: DataFrame, columns: Sequence[str], y: str, w: str, min_rows: int = 10) -> DataFrame:
    """``input, n, r``: weighted correlation of each column with ``y`` over the rows where both are known.

    NULL under ``min_rows`` rows or where either side is constant. All columns are one scan; a task gives one row per
    column.
    """
    names = list(columns)
    lean = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)], F.col(y).cast("double").alias("y"), F.col(w).cast("double").alias("w"))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((7, len(names)))  # rows, weight, mean x, mean y, and the products xx, xy, yy
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))])
            yy, ww = (batch.column(len(names) + i).to_numpy(zero_copy_only=False).astype(float)[:, None] for i in (0, 1))
            have = ~(np.isnan(x) | np.isnan(yy) | np.isnan(ww))
            heavy = np.where(have, ww, 0.0)
            total = heavy.sum(axis=0)
            safe = np.where(total > 0, total, 1.0)
            x, out = np.where(have, x, 0.0), np.where(have, yy, 0.0)
            mx, my = (heavy * x).sum(axis=0) / safe, (heavy * out).sum(axis=0) / safe
            ax, ay = np.where(have, x - mx, 0.0), np.where(have, out - my, 0.0)
            more = np.array([have.sum(axis=0), total, mx, my, (heavy * ax * ax).sum(axis=0), (heavy * ax * ay).sum(axis=0), (heavy * ay * ay).sum(axis=0)])
            both = held[1] + more[1]
            lever = np.where(both > 0, held[1] * more[1] / np.where(both > 0, both, 1.0), 0.0)
            gx, gy = more[2] - held[2], more[3] - held[3]
            step = np.where(both > 0, more[1] / np.where(both > 0, both, 1.0), 0.0)
            held = np.array([held[0] + more[0], both, held[2] + gx * step, held[3] + gy * step, held[4] + more[4] + lever * gx * gx,
                             held[5] + more[5] + lever * gx * gy, held[6] + more[6] + lever * gy * gy])
        used = np.flatnonzero(held[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(held[i, used]) for i in range(7)]], _PART_NAMES)

    parts = lean.mapInArrow(reduced, ", ".join(["place int", *[f"{n} double" for n in _PART_NAMES[1:]]]))
    # The parts are small: their own means are taken first, then what lies between them is added.

    def total(value: Callable[[Column], Column]) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda held, p: held + value(p))

    whole = parts.groupBy("place").agg(F.collect_list(F.struct(*_PART_NAMES[1:])).alias("parts")).select(
        "place", "parts", total(lambda p: p["n"]).alias("n"), total(lambda p: p["weight"]).alias("weight")
    )
    whole = whole.withColumns(
        {
            "amx": ratio(total(lambda p: p["weight"] * p["mx"]), F.col("weight")),
            "amy": ratio(total(lambda p: p["weight"] * p["my"]), F.col("weight")),
        }
    )

    def about(own: str, left: str, right: str) -> Column:
        return total(lambda p: p[own] + p["weight"] * (p[left] - F.col(f"a{left}")) * (p[right] - F.col(f"a{right}")))

    sums = whole.select("place", "n", "weight", "amx", "amy", about("xx", "mx", "mx").alias("xx"), about("xy", "mx", "my").alias("xy"), about("yy", "my", "my").alias("yy"))
    varies = (F.col("xx") > CONSTANT * F.col("weight") * F.col("amx") * F.col("amx")) & (F.col("xx") > 0)
    varies &= (F.col("yy") > CONSTANT * F.col("weight") * F.col("amy") * F.col("amy")) & (F.col("yy") > 0)
    strength = F.when((F.col("n") >= min_rows) & varies, ratio(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")))
    titles = F.array(*[F.lit(n) for n in names])
    every = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("place"), F.get(titles, F.col("id").cast("int")).alias("input"))
    return every.join(sums, "place", "left").select("input", F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("n"), strength.alias("r"))


_PART_NAMES = ["place", "n", "weight", "mx", "my", "xx", "xy", "yy"]
