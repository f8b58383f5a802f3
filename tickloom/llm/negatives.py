"""Hard-negative mining with exact integer scores by the method of the Four Russians.

A candidate is stored as packed bits: for each bit of its two's-complement components, one byte per group of eight
dimensions. An anchor has, per group, a table of the sums of all 256 subsets of its eight components. A byte of
the candidate is the index into that table, and a score is the sum of looked-up entries over the groups, shifted
and added over the bits. Blocks of anchors meet blocks of candidates: first those of the same label, which
gives the positives, then those of other labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.clusters import scaled_components, usable_vector
from tickloom.llm.common import staged
from tickloom.session import broadcast_if_small

GROUP = 8  # dimensions per table
BLOCK_ANCHORS = 1_024
BLOCK_CANDIDATES = 8_192
LANES = 32  # anchors scored at a time, so that their tables stay in a core's cache
NO_ID = -(2**63)  # a null id: smaller than all others, and given back as null


# --- bits and tables, in NumPy inside the tasks ---

def bit_planes(x: np.ndarray) -> np.ndarray:
    """(rows, bits, groups) bytes of the two's-complement components of ``x``; the last bit is the sign."""
    n, dims = x.shape
    groups = max(1, -(-dims // GROUP))
    wide = np.zeros((n, groups * GROUP), np.int64)
    wide[:, :dims] = x
    most = int(np.maximum(wide, ~wide).max(initial=0))
    bits = most.bit_length() + 1
    return np.stack([np.packbits(((wide >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)], axis=1)


def stacked_planes(rows: list[bytes], groups: np.ndarray) -> np.ndarray:
    """Planes of rows that were packed apart: missing groups are zeros, missing bits repeat the sign."""
    bits = np.array([len(r) for r in rows]) // groups
    out = np.zeros((len(rows), int(bits.max()), int(groups.max())), np.uint8)
    for b, g in set(zip(bits.tolist(), groups.tolist())):
        own = np.flatnonzero((bits == b) & (groups == g))
        part = np.frombuffer(b"".join(rows[i] for i in own), np.uint8).reshape(len(own), b, g)
        out[own, :b, :g] = part
        out[own, b:, :g] = part[:, -1:, :]
    return out


def subset_sums(anchors: np.ndarray, groups: int, bits: int) -> np.ndarray:
    """(groups, 256, anchors): entry ``m`` of a group is the sum of the components whose bit is set in ``m``."""
    n, dims = anchors.shape
    wide = np.zeros((n, max(groups * GROUP, dims)), np.int64)
    wide[:, :dims] = anchors
    wide = wide[:, : groups * GROUP]  # beyond the candidates' last dimension nothing counts
    small = float(np.abs(wide).sum(axis=1).max(initial=0)) * 2.0**bits < 2.0**31
    out = np.zeros((groups, 1 << GROUP, n), np.int32 if small else np.int64)
    for g in range(groups):
        for k in range(GROUP):
            out[g, 1 << k : 2 << k] = out[g, : 1 << k] + wide[:, g * GROUP + k]
    return out


def table_scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors) exact inner products: shift, look up and add, from the sign's plane down."""
    total = None
    for b in range(planes.shape[1] - 1, -1, -1):
        plane = tables[0][planes[:, b, 0]]
        for g in range(1, len(tables)):
            plane += tables[g][planes[:, b, g]]
        if total is None:
            total = -plane
        else:
            total <<= 1
            total += plane
    return total


# --- Spark ---

def mining_rows(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: str = "label", scale: int = 256, anchor: str = "id % 50 = 0"
) -> DataFrame:
    """Staged ``row`` (unique), ``id``, ``label``, ``planes``, ``groups``, and ``v`` for the rows that are anchors.

    ``label`` is an expression over the columns of ``rows``, ``anchor`` one over ``id``. Rows with a null
    label, a null vector, or a null or non-finite component take no part, nor do vectors so long (2^29) that
    scores might not fit a long. A null id stands before all others and is never an anchor; rows that share
    an id are rows of their own; vectors of unequal length count as zero beyond their end.
    """
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.expr(label).cast("long").alias("label"), F.col(vector_col).alias("x"))
    usable = named.filter(F.col("label").isNotNull() & usable_vector(F.col("x"), scale))
    whole = usable.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(NO_ID)).alias("id"), "label",
        scaled_components(F.col("x"), scale).alias("v"), (F.col("id").isNotNull() & F.coalesce(F.expr(anchor), F.lit(False))).alias("asks"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 2_048):
                part = batch.slice(start, 2_048)
                planes = bit_planes(_padded(part.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([p.tobytes() for p in planes], pa.binary()),
                     pa.array(np.full(len(part), planes.shape[2], np.int32)),
                     pa.array([v if asks else None for v, asks in zip(part.column(3).to_pylist(), part.column(4).to_pylist())], pa.list_(pa.int64()))],
                    ["row", "id", "label", "planes", "groups", "v"],
                )

    return staged(whole.mapInArrow(pack, "row long, id long, label long, planes binary, groups int, v array<long>"))


def _padded(vectors) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _each_score(asked: pd.DataFrame, offered: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the anchor, its scores with all of ``offered``)."""
    planes = stacked_planes(offered["planes"].tolist(), offered["groups"].to_numpy())
    for start in range(0, len(asked), LANES):
        lanes = asked.iloc[start : start + LANES]
        scores = table_scores(subset_sums(_padded(lanes["v"].tolist()), planes.shape[2], planes.shape[1]), planes)
        for i in range(len(lanes)):
            yield start + i, scores[:, i].astype(np.int64)


def _parts(column: str, size: int, per: Column) -> Column:
    """Block of a row among ``per`` rows cut into blocks of about ``size``, by the hash of the row number."""
    return F.pmod(F.xxhash64(F.lit(column), "row"), F.ceil(per / size)).cast("int").alias(column)


def _blocks(anchors: DataFrame, candidates: DataFrame, na: Column, nc: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with their block numbers: each anchor to every block of candidates, and the reverse.

    ``na`` and ``nc`` count the anchors and candidates that meet, so that a key with many rows, like one label
    for a third of the table, is as many blocks as it needs.
    """

    def every(per: Column, size: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.ceil(per / size) - 1).cast("int"))).alias(name)

    left = anchors.select("*", _parts("a_part", BLOCK_ANCHORS, na), every(nc, BLOCK_CANDIDATES, "c_part"))
    right = candidates.select("*", _parts("c_part", BLOCK_CANDIDATES, nc), every(na, BLOCK_ANCHORS, "a_part"))
    return left, right


def _meet(left: DataFrame, right: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn`` over each pair of blocks; the columns of the right side go by other names only until they are in the task."""
    own = ["row", "id", "planes", "groups", *keys, *({"label"} - set(keys))]
    other = right.select(*[F.col(c).alias(f"other_{c}") for c in own])

    def renamed(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        return fn(asked, offered.rename(columns=lambda c: c.removeprefix("other_")))

    return left.groupBy(*keys).cogroup(other.groupBy(*[f"other_{c}" for c in keys])).applyInPandas(renamed, schema)


def positives_of(rows: DataFrame, n_positives: int = 5) -> DataFrame:
    """``anchor`` (its row), ``row`` and ``id`` and ``score`` of the best ``n_positives`` other rows of the anchor's label."""
    anchors = rows.filter("v IS NOT NULL")
    # One narrow row per label; hinted after it was counted, and else joined by shuffle with skew splitting.
    sizes = broadcast_if_small(staged(rows.groupBy("label").agg(F.count("*").alias("nc"), F.count("v").alias("na")).filter("na > 0")))
    left, right = _blocks(
        anchors.select("row", "label", "v").join(sizes, "label"), rows.drop("v").join(sizes, "label"), F.col("na"), F.col("nc")
    )

    def best(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(offered):
            offered = offered.sort_values("id", ignore_index=True)
            own, ids = offered["row"].to_numpy(), offered["id"].to_numpy()
            for a, s in _each_score(asked, offered):
                row = asked["row"].iat[a]
                others = np.flatnonzero(own != row)
                if len(others) > n_positives:
                    floor = np.partition(s[others], len(others) - n_positives)[len(others) - n_positives]
                    others = others[s[others] >= floor]
                    others = others[np.argsort(-s[others], kind="stable")][:n_positives]
                found.append(pd.DataFrame({"anchor": row, "row": own[others], "id": ids[others], "score": s[others]}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"anchor": [], "row": [], "id": [], "score": []}).astype("int64")

    near = _meet(left, right, ["label", "a_part", "c_part"], best, "anchor long, row long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row"))
    return near.withColumn("place", place).filter(F.col("place") <= n_positives).drop("place")


def hard_negatives(rows: DataFrame, n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` over ``mining_rows``.

    For each anchor and each of its positives: the first ``n_negatives`` rows of another label, by falling
    score and then id, whose score is ``least`` to ``most`` per cent of the positive's. All positives or
    negatives where there are fewer; none for an anchor that is alone in its label, or in an empty table.
    Rows that tie in score and id give the same result whichever is taken.
    """
    good = staged(positives_of(rows, n_positives))
    marks = good.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("score", "id", "row"))).alias("marks"))
    anchors = rows.filter("v IS NOT NULL").select("row", F.col("id").alias("anchor_id"), "label", "v").join(
        marks.withColumnRenamed("anchor", "row"), "row"
    )
    na, nc = rows.agg(F.count("v"), F.count("*")).first()
    left, right = _blocks(anchors, rows.drop("v"), F.lit(max(na, 1)), F.lit(max(nc, 1)))

    def search(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(offered):
            offered = offered.sort_values("id", ignore_index=True)
            ids, labels = offered["id"].to_numpy(), offered["label"].to_numpy()
            for a, s in _each_score(asked, offered):
                mine = asked.iloc[a]
                # Scores fit 58 bits, so that their small multiples fit a long; floor and ceiling keep the bounds exact.
                bands = [(p["score"], p["id"], p["row"], -(-least * p["score"] // 100), most * p["score"] // 100) for p in mine["marks"]]
                low, high = min(b[3] for b in bands), max(b[4] for b in bands)
                wanted = np.flatnonzero((s >= low) & (s <= high) & (labels != mine["label"]))
                wanted = wanted[np.argsort(-s[wanted], kind="stable")]
                falling = -s[wanted]
                for score, pid, prow, floor, top in bands:
                    begin = int(np.searchsorted(falling, -top, "left"))
                    chosen = wanted[begin : begin + n_negatives]
                    for c in chosen[s[chosen] >= floor]:
                        out.append((mine["row"], mine["anchor_id"], prow, pid, score, int(ids[c]), int(s[c])))
        names = ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pd.DataFrame(out, columns=names).astype("int64")

    found = _meet(
        left, right, ["a_part", "c_part"], search,
        "anchor long, anchor_id long, positive long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id"))
    ids = {c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c) for c in ("positive_id", "negative_id")}
    return found.withColumn("rank", rank).filter(F.col("rank") <= n_negatives).select(
        "anchor_id", ids["positive_id"], "rank", ids["negative_id"], "positive_score", "negative_score"
    )
