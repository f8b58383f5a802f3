"""Exact top-k inner products by dual-tree search over cover trees.

A bounded sample gives the top level: pivots, whose cells split the rows into blocks, and a first bound on
every query's k-th score. Cells that cannot reach that bound for any query of a block of queries are never
paired with it. Within a pair of blocks both sides are indexed by a cover tree, and pairs of nodes are
pruned by their covering radii against the worst k-th score of the query node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut_lineage

SAMPLE_ROWS = 4_096  # rows, chosen by the hash of their id, that the top level is made from
PIVOTS = 64
BLOCK_ROWS = 2_048  # about the candidates of a block; a fuller cell is cut into several
BLOCK_QUERIES = 1_024
LEAF = 24
FANOUT = 64
EXACT = float(1 << 52)


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``id`` and ``v``, the floor of ``scale`` times each component.

    Rows with a null id, or a vector that is null, empty or has a null or non-finite component, are left
    out. Of repeated ids the smallest vector stays.
    """
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")).filter(
        "id IS NOT NULL AND x IS NOT NULL AND size(x) > 0"
    ).filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))))
    whole = F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return usable.select("id", whole.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows as one matrix; shorter vectors count as zero beyond their end."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products, as floats while those hold them and else as 64-bit integers."""
    if q.size and c.size and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= EXACT:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return q @ c.T


@dataclass
class Node:
    lo: int
    hi: int
    center: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray) -> tuple[Node, np.ndarray]:
    """Tree over ``points`` and the order in which each node's points are consecutive.

    A node's children are centres more than half its radius apart, the first being its own, and each point
    belongs to its nearest; so children lie within half the radius. A node that would need more than
    ``FANOUT`` centres has no structure to prune by and stays a leaf, as does one with few or equal points.
    """
    order = np.arange(len(points))

    def grow(lo: int, hi: int, center: np.ndarray) -> Node:
        own = points[order[lo:hi]]
        gap = np.sqrt(((own - center) ** 2).sum(axis=1))
        node = Node(lo, hi, center, float(gap.max()))
        if hi - lo <= LEAF or node.radius == 0:
            return node
        nearest, owner, centers = gap, np.zeros(hi - lo, np.int64), [center]
        while nearest.max() > node.radius / 2:
            far = own[int(nearest.argmax())]
            centers.append(far)
            if len(centers) > FANOUT:
                return node
            d = np.sqrt(((own - far) ** 2).sum(axis=1))
            closer = d < nearest
            nearest, owner = np.where(closer, d, nearest), np.where(closer, len(centers) - 1, owner)
        order[lo:hi] = order[lo:hi][np.argsort(owner, kind="stable")]
        ends = np.cumsum(np.bincount(owner, minlength=len(centers)))
        begin = lo
        for c, end in zip(centers, ends + lo):
            if end > begin:
                node.children.append(grow(begin, int(end), c))
            begin = int(end)
        return node

    return grow(0, len(points), points[0]), order


def dual_tree(
    q: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of up to ``k`` best candidates per query that reach its floor."""
    q_tree, q_order = cover_tree(q)
    c_tree, c_order = cover_tree(c)
    q, q_ids, kth = q[q_order], q_ids[q_order], floors[q_order].astype(float).copy()
    c, c_ids = c[c_order], c_ids[c_order]
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def bound(a: Node, b: Node) -> float:
        top = a.center @ b.center + a.radius * np.sqrt(b.center @ b.center) + b.radius * np.sqrt(a.center @ a.center) + a.radius * b.radius
        return float(top + 1e-9 * abs(top) + 1e-3)  # rounding must never prune

    stack = [(bound(q_tree, c_tree), q_tree, c_tree)]
    while stack:
        most, a, b = stack.pop()
        if most < kth[a.lo : a.hi].min():
            continue
        if not a.children and not b.children:
            s = _scores(q[a.lo : a.hi], c[b.lo : b.hi])
            row, col = np.nonzero((s >= kth[a.lo : a.hi, None]) & (q_ids[a.lo : a.hi, None] != c_ids[None, b.lo : b.hi]))
            if len(row):
                best = tuple(np.concatenate(x) for x in zip(best, (row + a.lo, c_ids[col + b.lo], s[row, col].astype(best[2].dtype if s.dtype != np.int64 else np.int64))))
                by = np.lexsort((best[1], -best[2], best[0]))
                best = tuple(x[by] for x in best)
                first = np.searchsorted(best[0], best[0])
                best = tuple(x[np.arange(len(by)) - first < k] for x in best)
                rows, begin, count = np.unique(best[0], return_index=True, return_counts=True)
                full = count == k
                kth[rows[full]] = np.maximum(kth[rows[full]], best[2][begin[full] + k - 1])
            continue
        # Open the wider node, so that both sides shrink together; the most promising pair comes next.
        pairs = [(x, b) for x in a.children] if a.children and (not b.children or a.radius > b.radius) else [(a, y) for y in b.children]
        stack += sorted(((bound(x, y), x, y) for x, y in pairs), key=lambda t: t[0])
    return q_order[best[0]], best[1], best[2]


def top_k(vectors: DataFrame, k: int = 10, query: str = "id % 100 = 0") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row of ``vectors`` (``id``, ``v``) that
    ``query`` chooses, the ``k`` best other rows by inner product, ties to the smaller id; all if fewer.

    An empty table, or one without queries, gives no rows; a single row has no others. Equal vectors are
    separate candidates. A cell with very many rows is cut into blocks by the hash of the id, so neither a
    task nor a group holds more than about a block of candidates and a block of queries.
    """
    spark = vectors.sparkSession
    sampled = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    shape = "query_id long, rank int, vec_id long, score long"
    if sampled.empty:
        return spark.createDataFrame([], shape)
    width = max(len(v) for v in sampled["v"])
    sample, sample_ids = _matrix(sampled["v"], width), sampled["id"].to_numpy()
    pivots = sample[:1]
    gap = np.sqrt(((sample - pivots[0]) ** 2).sum(axis=1))
    while len(pivots) < PIVOTS and gap.max() > 0:
        pivots = np.vstack([pivots, sample[int(gap.argmax())]])
        gap = np.minimum(gap, np.sqrt(((sample - pivots[-1]) ** 2).sum(axis=1)))
    top = spark.sparkContext.broadcast((pivots, sample, sample_ids))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, sample, sample_ids = top.value
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                ids, lists, asked = part.column(0).to_numpy(), part.column(1).to_pylist(), np.asarray(part.column(2))
                wide = max(width, max(len(v) for v in lists))
                x = _matrix(lists, wide)
                d = ((x[:, None, :width] - pivots[None]) ** 2).sum(axis=2) + (x[:, None, width:] ** 2).sum(axis=2)
                floors = np.full(len(x), -np.inf)
                if asked.any():
                    s = _scores(x[asked][:, :width], sample).astype(float)
                    s[ids[asked][:, None] == sample_ids[None]] = -np.inf
                    if s.shape[1] >= k:
                        floors[asked] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(d.argmin(axis=1)), pa.array(np.sqrt(d.min(axis=1))), pa.array(floors)],
                    ["id", "v", "asked", "cell", "gap", "floor"],
                )

    placed = cut_lineage(
        vectors.select("id", "v", F.expr(query).alias("asked"))
        .mapInArrow(place, "id long, v array<long>, asked boolean, cell long, gap double, floor double")
    )
    # At most PIVOTS rows.
    cells = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("gap").alias("radius"), F.sum(F.col("asked").cast("long")).alias("asked")
    ).toPandas().sort_values("cell")
    radius = np.zeros(len(pivots))
    radius[cells["cell"]] = cells["radius"]
    salts = {int(c): int(-(-n // BLOCK_ROWS)) for c, n in zip(cells["cell"], cells["n"])}
    # Queries of neighbouring small cells share a block, those of a full cell are spread over several.
    lanes, block, filled = {}, 0, 0
    for cell, n in zip(cells["cell"].astype(int), cells["asked"].astype(int)):
        spread = -(-n // BLOCK_QUERIES)
        if filled + n > BLOCK_QUERIES and filled:
            block, filled = block + 1, 0
        lanes[cell] = (block, max(1, spread))
        block, filled = (block + spread, 0) if spread > 1 else (block, filled + n)

    def by_cell(values: dict[int, int]):
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("cell").cast("int"))

    spread = F.pmod(F.xxhash64("id"), by_cell({c: s for c, (_, s) in lanes.items()}))
    asked = placed.filter("asked").select("id", "v", "floor", (by_cell({c: b for c, (b, _) in lanes.items()}) + spread).alias("q_block"))
    reach = spark.sparkContext.broadcast((pivots, radius))

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells whose bound reaches the floor of the query."""
        pivots, radius = reach.value
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist(), width)[:, :width] if all(len(v) <= width for v in batch.column(1).to_pylist()) else None
            floors = np.asarray(batch.column(2))
            for i in range(len(batch)):
                if x is None:
                    open_ = np.arange(len(pivots))
                else:
                    most = pivots @ x[i] + radius * np.sqrt(x[i] @ x[i])
                    open_ = np.flatnonzero(most + 1e-9 * np.abs(most) + 1e-3 >= floors[i])
                n = len(open_)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array([batch.column(1)[i].as_py()] * n, pa.list_(pa.int64())),
                     pa.array(np.full(n, floors[i])), pa.array([batch.column(3)[i].as_py()] * n, pa.int64()), pa.array(open_, pa.int64())],
                    ["id", "v", "floor", "q_block", "cell"],
                )

    wanted = cut_lineage(asked.mapInArrow(needs, "id long, v array<long>, floor double, q_block long, cell long"))
    known = wanted.filter(F.col("cell").isin(list(salts)))
    left = known.withColumn("part", F.explode(F.sequence(F.lit(0), (by_cell(salts) - 1).cast("int"))))
    pairs = known.select("q_block", "cell").distinct()
    right = placed.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), by_cell(salts)).cast("int")).join(pairs, "cell")
    keys = ["q_block", "cell", "part"]

    def search(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or offered.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        wide = max(max(map(len, asked["v"])), max(map(len, offered["v"])))
        row, vec, score = dual_tree(
            _matrix(asked["v"], wide), asked["id"].to_numpy(), asked["floor"].to_numpy(),
            _matrix(offered["v"], wide), offered["id"].to_numpy(), k,
        )
        return pd.DataFrame({"query_id": asked["id"].to_numpy()[row], "vec_id": vec, "score": score.astype(np.int64)})

    found = (
        left.select(*keys, "id", "v", "floor").groupBy(*keys)
        .cogroup(right.select(*[F.col(c).alias(f"other_{c}") for c in keys], "id", "v").groupBy(*[f"other_{c}" for c in keys]))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
