"""Exact integer k-means whose nearest-centroid searches go through a LAESA pivot table.

The distances of every vector to a few fixed pivots are computed once and stored beside it. In each round the
driver adds the pivots' distances to the (at most ``k``) centroids; by the triangle inequality the largest
difference of the two is a lower bound, and only centroids whose bound does not exceed the best distance found
so far get an exact one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import staged

PIVOTS = 12
PIVOT_SAMPLE = 1_024  # rows, chosen by the hash of their id, that pivots are picked from
SLICE_ROWS = 2_048
# Vectors longer than this (squared) are left out: products and distances of two of them would not fit a long.
LONGEST = float(1 << 58)
SLACK = 1e-9  # rounding of the stored distances must never prune


def scaled_components(vector: Column, scale: int) -> Column:
    """Floor of ``scale`` times each component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable_vector(vector: Column, scale: int) -> Column:
    """True if no component is null or non-finite and the scaled vector's square stays below ``LONGEST``."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    square = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + F.floor(x.cast("double") * scale).cast("double") * F.floor(x.cast("double") * scale).cast("double")
    )
    return F.coalesce(finite & F.when(finite, square < LONGEST), F.lit(False))


def kept_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """``id``, ``v`` and ``h`` (the hash that picks the first centroids) of the vectors with ``dims`` usable components.

    Vectors that are null, of another length, or hold a null or non-finite component are left out, as are
    those so long (2^29) that a squared distance might not fit a long. A null id is kept, and hashed as an
    empty one; rows with one id are vectors of their own.
    """
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    sized = named.filter(F.coalesce(F.size("x") == dims, F.lit(False)))
    seed = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return sized.filter(usable_vector(F.col("x"), scale)).select("id", scaled_components(F.col("x"), scale).alias("v"), seed.alias("h"))


def far_apart(points: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` distinct points, each the farthest from those before it."""
    chosen = points[:1]
    gap = ((points - chosen[0]).astype(float) ** 2).sum(axis=1)
    while len(chosen) < most and gap.max() > 0:
        chosen = np.vstack([chosen, points[int(gap.argmax())]])
        gap = np.minimum(gap, ((points - chosen[-1]).astype(float) ** 2).sum(axis=1))
    return chosen


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to one vector."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, table: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each row of ``x``, and how many exact distances that took.

    ``table`` holds the rows' distances to the pivots, ``to_pivots`` those of the centroids. Ties go to the
    smaller centroid number.
    """
    low = np.zeros((len(x), len(centroids)))
    for p in range(table.shape[1]):
        np.maximum(low, np.abs(table[:, p, None] - to_pivots[None, :, p]), out=low)
    low = np.maximum(low * (1 - SLACK) - SLACK * (1 + table.max(axis=1, initial=0.0))[:, None], 0.0) ** 2
    first = low.argmin(axis=1)
    rows = np.arange(len(x))
    owner, best = first.copy(), np.empty(len(x), np.int64)
    for c in np.unique(first):
        own = first == c
        best[own] = squared(x[own], centroids[c])
    exact = len(x)
    # The centroid with the smallest bound gave the first distance; the others follow in order of their numbers.
    for c in range(len(centroids)):
        open_ = rows[(low[:, c] <= best) & (first != c)]
        if len(open_):
            d = squared(x[open_], centroids[c])
            exact += len(open_)
            closer = (d < best[open_]) | ((d == best[open_]) & (c < owner[open_]))
            best[open_[closer]], owner[open_[closer]] = d[closer], c
    return owner, best, exact


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _matrix(column: pa.Array, dtype=None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (flat if dtype is None else flat.astype(dtype)).reshape(len(column), -1)


@dataclass
class Clustering:
    """``rows``: ``id``, ``cluster``, ``distance``; ``centroids``: k by dims, of Python's integers."""

    rows: DataFrame
    centroids: list[list[int]]
    exact_share: float | None = None


def pivot_table(vectors: DataFrame, pivots: int = PIVOTS, sample_rows: int = PIVOT_SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` (``id``, ``v``, ``h``) with ``t``, the distances to fixed pivots, as a table of the shared folder.

    Pivots are picked far apart from a bounded sample; the choice changes the work, never the result.
    """
    sample = vectors.orderBy("h", "v").limit(sample_rows).select("v").collect()
    fixed = far_apart(np.array([r.v for r in sample], np.int64), pivots) if sample else np.zeros((0, 0), np.int64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            x = _matrix(part.column(1))
            t = np.sqrt(np.stack([squared(x, p) for p in fixed], axis=1).astype(float))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * len(fixed), pa.int32()), pa.array(t.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], ["id", "v", "h", "t"])

    return staged(vectors.mapInArrow(measure, "id long, v array<long>, h string, t array<double>")), fixed


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5) -> Clustering:
    """Lloyd rounds in whole numbers over all ``vectors`` (``id``, ``v``, ``h``), then one last assignment.

    The ``k`` vectors of smallest ``h`` (ties: smaller vector) are the first centroids, fewer if there are
    fewer vectors. A round assigns each vector to its nearest centroid, ties to the smaller number, and moves
    every centroid that has vectors to the exact floor of their mean. Equal vectors count as often as they
    occur. An empty table gives no rows and no centroids.

    A round shuffles one partial sum per task, cluster and component; only ``k`` summed vectors reach the driver.
    """
    table, pivots = pivot_table(vectors)
    centroids = [list(r.v) for r in table.orderBy("h", "v").limit(k).select("v").collect()]
    if not centroids:
        return Clustering(table.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [])
    dims = len(centroids[0])

    def now() -> tuple[np.ndarray, np.ndarray]:
        c = np.array(centroids, np.int64)
        return c, np.sqrt(np.stack([squared(c, p) for p in pivots], axis=1).astype(float))

    def summed(batches: Iterator[pa.RecordBatch], c: np.ndarray, gaps: np.ndarray) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(c), dims), np.int64), np.zeros(len(c), np.int64)
        for part in _slices(batches):
            x = _matrix(part.column(0))
            owner, _, _ = nearest(x, _matrix(part.column(1)), c, gaps)
            np.add.at(total, owner, x)
            count += np.bincount(owner, minlength=len(c))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dims + 1), pa.int32()), pa.array(np.tile(np.arange(-1, dims), len(used)), pa.int32()),
             pa.array(np.column_stack([count[used], total[used]]).ravel())],
            ["cluster", "place", "total"],
        )

    for _ in range(rounds):
        c, gaps = now()
        sums = (
            table.select("v", "t")
            .mapInArrow(lambda batches, c=c, gaps=gaps: summed(batches, c, gaps), "cluster int, place int, total long")
            .groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
            .groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("place", "total"))).alias("parts"))
            .collect()
        )
        for row in sums:  # at most k rows of dims sums; place -1 is the count
            count, *totals = (int(p.total) for p in row.parts)
            centroids[row.cluster] = [t // count for t in totals]

    c, gaps = now()

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            owner, best, exact = nearest(_matrix(part.column(1)), _matrix(part.column(2)), c, gaps)
            spent = np.zeros(len(part), np.int64)
            spent[0] = exact
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(owner, pa.int32()), pa.array(best), pa.array(spent)], ["id", "cluster", "distance", "spent"]
            )

    rows = staged(table.select("id", "v", "t").mapInArrow(assigned, "id long, cluster int, distance long, spent long"))
    spent, n = rows.agg(F.sum("spent"), F.count("*")).first()
    return Clustering(rows.select("id", "cluster", "distance"), centroids, spent / (n * len(centroids)))


def cluster_report(done: Clustering) -> DataFrame:
    """``rows`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``; null where a sum does not fit a long.

    The ``k`` sums (at most) come to the driver and go back as a broadcast table of ``k`` rows.
    """
    found = done.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    totals = {r.cluster: int(r.total) for r in found}

    def as_long(value: int) -> int | None:
        return value if value < 2**63 else None

    each = [
        (i, as_long(totals.get(i, 0)), as_long(sum(totals.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(done.centroids)
    ]
    named = done.rows.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.rows.join(F.broadcast(named), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
