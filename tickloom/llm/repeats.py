"""Finding windows that occur again anywhere, exactly: what substring and suffix-array dedup share.

Every window of ``length`` symbols holds an anchor, its leftmost smallest gram hash. Equal windows hold equal
anchors, so only the stretches around anchors whose gram occurs again need a closer look. Equal stretches are
settled by counting; the distinct stretches around one gram form a group, which a suffix array or tree
settles inside a task. Groups with very many distinct stretches are cut anew with longer grams, at last with
grams as long as the window, so that no group outgrows a task and none is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.batches import pieces
from tickloom.llm.common import staged
from tickloom.session import broadcast_if_small

ODD = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(ODD, -1, 1 << 64)
PIECE_BYTES = 1 << 20  # of texts looked at together; several arrays of eight times that size exist at once
SETTLE_BYTES = 2 << 20
RUNS_AT_ONCE = 200_000
CROWDED_TEXTS = 50_000  # most texts with crowded stretches whose list is broadcast rather than shuffled


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Symbols:
    """How texts become symbols. ``read`` gives the symbols of all texts and the number of each text's,
    ``hashed`` a 64-bit hash of each symbol.

    ``settle(stretches, group)`` gets stretches of symbols and returns, per stretch, which of its windows occur
    in another one of its group or at another place of itself.
    """

    length: int
    grams: tuple[int, ...]
    crowd: int  # most distinct stretches of a group that are settled together
    kind: type  # of a symbol
    read: Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]
    hashed: Callable[[np.ndarray], np.ndarray]
    settle: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]]


def _powers(n: int, base: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


class Sums:
    """Running sums from which the hash of any stretch follows."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.back = _powers(n + 1, INVERSE)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(n, ODD), out=self.total[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.total[hi] - self.total[lo]) * self.back[lo])


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    if width == 1:
        return x
    whole = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    whole[: len(x)] = x
    rows = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(values: np.ndarray, sizes: np.ndarray, length: int, gram: int, allowed: np.ndarray | None = None):
    """(text, first start, starts - 1, gram hash, stretch hash) of each run of windows with one anchor.

    ``allowed`` marks the starts to look at, none given: all.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(values)
    if n < length:
        return none
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start_ok = np.arange(n) + length <= ends[text]
    if allowed is not None:
        start_ok &= allowed
    sums = Sums(values)
    at = np.arange(n - gram + 1)
    hashes = sums.of(at, at + gram)
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    anchor = _sliding_minimum(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)
    starts = np.flatnonzero(start_ok[: len(anchor)])
    if not len(starts):
        return none
    anchor = anchor[starts].astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1) | (text[starts[1:]] != text[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, p = starts[first], starts[last], anchor[first]
    stretch = mixed(sums.of(lo, hi + length) + (p - lo).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (hi - lo).astype(np.uint64))
    owner = text[lo]
    return owner, lo - (ends - sizes)[owner], hi - lo, hashes[p], stretch


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(symbols: Symbols, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of key, body and optionally the windows to look at: an anchor per row."""
        for batch in batches:
            for part in pieces(batch, batch.schema.get_field_index("body"), PIECE_BYTES):
                values, sizes = symbols.read(part.column("body").to_pylist())
                values = symbols.hashed(values)
                allowed = None
                if "windows" in part.schema.names:
                    edge = np.zeros(len(values) + 1, np.int64)
                    begin = np.cumsum(sizes) - sizes
                    lists = part.column("windows")
                    at = np.asarray(lists.flatten(), dtype=np.int64)
                    base = np.repeat(begin, np.diff(np.asarray(lists.offsets)))
                    np.add.at(edge, base + (at >> 8), 1)
                    np.add.at(edge, base + (at >> 8) + (at & 255) + 1, -1)
                    allowed = np.cumsum(edge)[:-1] > 0
                text, lo, more, h, r = anchor_runs(values, sizes, symbols.length, gram, allowed)
                keys = np.asarray(part.column("key"), dtype=np.int64)[text]
                for a in range(0, len(text), RUNS_AT_ONCE):
                    s = slice(a, a + RUNS_AT_ONCE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[s]), _signed(h[s]), _signed(r[s]), pa.array((lo << 8 | more)[s])], ["key", "h", "r", "at"]
                    )

    return run


def _cut(symbols: Symbols):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of key, body and its stretches: a row per stretch, with its symbols."""
        for batch in batches:
            for part in pieces(batch, batch.schema.get_field_index("body"), PIECE_BYTES):
                values, sizes = symbols.read(part.column("body").to_pylist())
                keys = part.column("key").to_pylist()
                begin = np.cumsum(sizes) - sizes
                for i, stretches in enumerate(part.column("stretches").to_pylist()):
                    bodies = [values[begin[i] + (s["at"] >> 8) : begin[i] + (s["at"] >> 8) + (s["at"] & 255) + symbols.length].tobytes() for s in stretches]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([s["h"] for s in stretches], pa.int64()), pa.array([keys[i]] * len(bodies), pa.int64()),
                            pa.array([s["at"] for s in stretches], pa.int64()), pa.array([s["known"] for s in stretches], pa.bool_()),
                            pa.array(bodies, pa.binary()),
                        ],
                        ["h", "key", "at", "known", "body"],
                    )

    return run


def _settled(symbols: Symbols):
    def spans(rows: list) -> pa.RecordBatch:
        group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        marks = symbols.settle([np.frombuffer(r[4], symbols.kind) for r in rows], group)
        keys, first, last = [], [], []
        for (_, key, at, known, _), mark in zip(rows, marks):
            if not known and mark.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
                for a, b in zip(edge[0::2], edge[1::2] - 1):
                    keys.append(key)
                    first.append((at >> 8) + int(a))
                    last.append((at >> 8) + int(b))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of stretches sorted by group: whole groups are settled together, a bounded number of bytes at once."""
        held: list = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SETTLE_BYTES and row[0] != held[-1][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield spans(held)

    return run


def repeated_windows(base: DataFrame, symbols: Symbols) -> DataFrame:
    """``key`` and ``spans`` (first and last start of a run) of all windows of ``body`` that occur again.

    ``base`` has ``key``, ``body`` and any other columns; keys need not be unique if equal keys have equal
    bodies. Counting is pre-aggregated in every task; joins are by hash and can be split where a gram is
    frequent. The result holds plans over the staged stretches, so that one shuffle of the texts by key
    serves all of them and the caller's own join of ``base`` by key.
    """
    found: list[DataFrame] = []
    source = base
    lo, hi = F.shiftright("at", 8), F.shiftright("at", 8) + F.col("at").bitwiseAND(F.lit(255))
    for gram in symbols.grams:
        anchors = source.mapInArrow(_anchors(symbols, gram), "key long, h long, r long, at long")
        twice = anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
        again = staged(anchors.join(twice, "h"))
        units = again.groupBy("h", "r").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one"))
        units = staged(units.join(units.groupBy("h").agg(F.count("*").alias("distinct")), "h"))
        sure = again.join(units.filter("n > 1").select("h", "r"), ["h", "r"])
        found.append(sure.select("key", lo.alias("a"), hi.alias("b")))
        if gram == symbols.length:
            break  # a stretch is one window, so counting has settled it
        stretch = F.struct("h", F.col("one.at").alias("at"), (F.col("n") > 1).alias("known"))
        contested = units.filter(F.col("distinct").between(2, symbols.crowd)).groupBy(F.col("one.key").alias("key")).agg(
            F.collect_list(stretch).alias("stretches")
        )
        cut = base.join(contested, "key").mapInArrow(_cut(symbols), "h long, key long, at long, known boolean, body binary")
        found.append(cut.repartition("h").sortWithinPartitions("h").mapInArrow(_settled(symbols), "key long, a long, b long"))
        crowded = units.filter(F.col("distinct") > symbols.crowd)
        if crowded.isEmpty():
            break
        windows = crowded.groupBy(F.col("one.key").alias("key")).agg(F.collect_list("one.at").alias("windows"))
        source = base.join(broadcast_if_small(staged(windows), CROWDED_TEXTS), "key")
    spans = reduce(DataFrame.unionByName, found)
    return spans.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def covered(spans: list[dict], length: int, n: int) -> np.ndarray:
    """Which of ``n`` symbols the windows starting in ``spans`` cover."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(edge, [s["a"] for s in spans], 1)
        np.add.at(edge, [s["b"] + length for s in spans], -1)
    return np.cumsum(edge)[:-1] > 0
