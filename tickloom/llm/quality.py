"""Quality classifier: random-indexing word vectors, pooled per document, under a small network.

Word vectors come from all documents; only the network is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.batches import Buckets, per_group, pieces
from tickloom.llm.common import crc_fold

WORDS = 1 << 14  # buckets of words; with DIM this bounds what is collected and broadcast (8 MB)
DIM = 64
NONZERO = 2
REACH = 2  # neighbours on each side
HIDDEN = 32
LABELLED_ROWS = 20_000  # most labelled rows the network is fitted on, chosen by the hash of their id
FOLDS, HELD_OUT = 3, 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def index_cells(seed: int) -> np.ndarray:
    """Per word bucket the cells of its sparse index vector; cell ``2 * d + 1`` stands for -1 at ``d``."""
    keys = np.arange(WORDS * NONZERO, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)
    return (_mixed(keys) % np.uint64(2 * DIM)).astype(np.int64).reshape(WORDS, NONZERO)


def context_sums(docs: DataFrame, text_col: str, seed: int) -> DataFrame:
    """``word`` and ``v``: the summed index vectors of its neighbours over every occurrence.

    A task sums its own documents first and passes on one vector per word, so the shuffle is bounded by
    words times tasks whatever word is frequent.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, cells = Buckets(WORDS, True), index_cells(seed)
        total = np.zeros(WORDS * 2 * DIM, np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                ids, sizes = buckets.of_texts(part.column(0).to_pylist())
                doc = np.repeat(np.arange(len(sizes)), sizes)
                for step in range(1, REACH + 1):
                    near = doc[step:] == doc[:-step]
                    left, right = ids[:-step][near], ids[step:][near]
                    for own, other in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            total += np.bincount(own * (2 * DIM) + cells[other, k], minlength=len(total))
        signed = total.reshape(WORDS, DIM, 2)
        signed = signed[:, :, 0] - signed[:, :, 1]
        used = np.flatnonzero(total.reshape(WORDS, -1).any(axis=1))
        for lo in range(0, len(used), 2048):
            rows = used[lo : lo + 2048]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.FixedSizeListArray.from_arrays(pa.array(signed[rows].ravel()), DIM).cast(pa.list_(pa.int64()))],
                ["word", "v"],
            )

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(sums, "word long, v array<long>")
    return parts.groupBy("word").agg(F.array(*[F.sum(F.get("v", F.lit(d))) for d in range(DIM)]).alias("v"))


def word_vectors(docs: DataFrame, text_col: str = "text", seed: int = 7) -> np.ndarray:
    """Own index vector plus the direction of the summed contexts, for each of the ``WORDS`` buckets."""
    own = np.zeros((WORDS, 2 * DIM))
    np.add.at(own, (np.arange(WORDS)[:, None], index_cells(seed)), 1.0)
    vectors = own[:, 0::2] - own[:, 1::2]
    for row in context_sums(docs, text_col, seed).toArrow().to_batches():
        sums = np.asarray(row.column(1).flatten(), dtype=np.float64).reshape(-1, DIM)
        vectors[np.asarray(row.column(0))] += sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return vectors.astype(np.float32)


def pooled(ids: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, at_once: int = 200_000) -> np.ndarray:
    """Mean word vector and log length of each text; texts without tokens are all zero."""
    sums = np.zeros((len(sizes), DIM))
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo] - sizes[lo]) + at_once, "right")))
        begin = ends[lo] - sizes[lo]
        if hi == lo + 1:  # a long text is added up piece by piece
            for a in range(begin, ends[lo], at_once):
                sums[lo] += vectors[ids[a : min(a + at_once, ends[lo])]].sum(axis=0, dtype=np.float64)
        else:
            sums[lo:hi] = per_group(vectors[ids[begin : ends[hi - 1]]], sizes[lo:hi])
        lo = hi
    return np.column_stack([sums / np.maximum(sizes, 1)[:, None], np.log1p(sizes)])


@dataclass
class Network:
    """Two layers with a temperature: logistic of (tanh(x W1 + b1) w2 + b2) / temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(y) else 0.0


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 80, batch: int = 256, rate: float = 5e-3) -> Network:
    """Adam on four fifths of the rows; the temperature is the best one on the remaining fifth.

    With no rows every score is one half; with one class only the network stays near its share.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    net = Network(np.zeros(d), np.ones(d), rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if not len(y):
        return net
    order = rng.permutation(len(y))
    x, y = x[order], y[order].astype(np.float64)
    n = max(1, len(y) - len(y) // 5)
    net.mean, net.scale = x[:n].mean(axis=0), x[:n].std(axis=0) + 1e-6
    share = (y[:n].sum() + 0.5) / (n + 1)
    net.b2 = float(np.log(share / (1 - share)))
    xs = (x[:n] - net.mean) / net.scale
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    t = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // batch)):
            a = np.tanh(xs[rows] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(e, p[2]) * (1 - a * a)
            grads = [xs[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), a.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            t += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] = p[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    if len(y) - n >= 10:
        z = net.logits(x[n:])
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda s: _loss(z / s, y[n:])))
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, learn, most: int) -> DataFrame:
    """``text`` and ``y`` of at most ``most`` labelled rows, by hash of the id; unlabelled ids are left out."""
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("k"), F.col(label).cast("int").alias("y"))
        .filter(F.col("k").isNotNull() & F.col("y").isin(0, 1) & learn(F.col("k")))
        .orderBy(F.xxhash64("k"), "k", "y").limit(most)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "k").select("k", "text", "y")  # at most ``most`` rows


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    learn=lambda k: crc_fold(k, FOLDS) != HELD_OUT, most: int = LABELLED_ROWS, seed: int = 7,
) -> DataFrame:
    """``row`` and ``score``, the calibrated probability of label 1, for every row.

    Null and empty texts pool to zero and get the score the network gives to that. Repeated rows and ties
    get equal scores, null ids are scored but never learned from, other columns are not read. An empty
    table gives an empty table; without labels every score is 0.5.
    """
    vectors = word_vectors(docs, text_col, seed)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(WORDS, True)
        for batch in batches:
            for part in pieces(batch, 1):
                x = pooled(*buckets.of_texts(part.column(1).to_pylist()), shared.value)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat, part.column(2)], ["k", "x", "y"])

    sample = labelled_sample(docs, labels, label, id_col, text_col, learn, most)
    rows = sample.mapInArrow(features, "k long, x array<double>, y int").orderBy("k", "y").toArrow()
    x = np.asarray(rows.column("x").combine_chunks().flatten(), dtype=np.float64).reshape(-1, DIM + 1)
    net = fit_network(x, np.asarray(rows.column("y"), dtype=np.int64), seed)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(WORDS, True)
        for batch in batches:
            for part in pieces(batch, 1):
                x = pooled(*buckets.of_texts(part.column(1).to_pylist()), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(net.score(x))], ["row", "score"])

    base = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("body"))
    kind = base.schema["row"].dataType.simpleString()
    return base.mapInArrow(scores, f"row {kind}, score double")
