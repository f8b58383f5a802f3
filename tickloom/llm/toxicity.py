"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.batches import Buckets, pieces
from tickloom.llm.common import crc_fold
from tickloom.llm.quality import labelled_sample

WORDS = 1 << 17  # buckets of words, so the weights take 1 MB
LABELLED_ROWS = 20_000  # most labelled rows the weights are fitted on, chosen by the hash of their id
FOLDS, HELD_OUT = 5, 0
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
LOGIT_BOUND = 30.0


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Character spans of sentences: up to a stop or a line end, blank ones left out."""
    return [m.span() for m in SENTENCE.finditer(text)] if text else []


def _instances(texts: list[str | None], buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, words per sentence, sentences per text."""
    sentences = [SENTENCE.findall(t) if t else [] for t in texts]
    ids, sizes = buckets.of_texts([s for row in sentences for s in row])
    return ids, sizes, np.array([len(r) for r in sentences], np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _log_clean(weights: np.ndarray, bias: float, ids, sizes) -> tuple[np.ndarray, np.ndarray]:
    """Per sentence its score and the logarithm of one minus it."""
    z = np.clip(_sums(weights[ids], sizes) + bias, -LOGIT_BOUND, LOGIT_BOUND)
    return 1 / (1 + np.exp(-z)), -np.logaddexp(0, z)


def telling_words(with_word: np.ndarray, with_both: np.ndarray, n: float, n1: float) -> np.ndarray:
    """Buckets whose share of documents differs between the labels: log-likelihood ratio against chance.

    The bound grows with the logarithm of the words compared, as a test of so many words has to. Without
    it the many words that occur in one or two documents would explain the labels by heart.
    """

    def log_likelihood(hits, of):
        p = np.clip(hits / np.maximum(of, 1), 1e-12, 1 - 1e-12)
        return hits * np.log(p) + (of - hits) * np.log1p(-p)

    apart = log_likelihood(with_both, n1) + log_likelihood(with_word - with_both, n - n1)
    pooled = np.clip(with_word / max(n, 1), 1e-12, 1 - 1e-12)
    together = with_word * np.log(pooled) + (n - with_word) * np.log1p(-pooled)
    return np.flatnonzero(2 * (apart - together) > 2.2 * np.log(max(2, (with_word > 0).sum())))


def fit_sentences(kept, cell, sentence, counts, y, rounds: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of the kept words and bias, by Adam on the likelihood of the document labels.

    ``cell`` and ``sentence`` pair each occurrence of a kept word with its sentence, ``counts`` has the
    sentences per document. A document's probability is the noisy-or of its sentences. Without both classes
    the weights are zero.
    """
    weights, bias = np.zeros(WORDS), -7.0
    if not len(y) or y.min() == y.max():
        return weights, bias
    owner = np.repeat(np.arange(len(counts)), counts)
    theta = np.append(np.zeros(len(kept)), -4.0)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, weights=theta[cell], minlength=len(owner)) + theta[-1]
        z = np.clip(z, -LOGIT_BOUND, LOGIT_BOUND)
        clean = np.exp(_sums(-np.logaddexp(0, z), counts))
        pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) / len(y)
        g = pull[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(cell, weights=g[sentence], minlength=len(kept)) + ridge * theta[:-1], g.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights[kept] = theta[:-1]
    return weights, float(theta[-1])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    learn=lambda k: crc_fold(k, FOLDS) != HELD_OUT, most: int = LABELLED_ROWS,
) -> tuple[np.ndarray, float]:
    """Sentence model from at most ``most`` labelled documents.

    The executors count words per label and, once the telling words are known, pass on only those with the
    number of their sentence; no text and no other word reaches the driver.
    """
    sample = labelled_sample(docs, labels, label, id_col, text_col, learn, most)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = Buckets(WORDS, False), np.zeros((2, WORDS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                total[y, np.unique(buckets.of_texts([text])[0])] += 1
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0, used]), pa.array(total[1, used])], ["word", "n0", "n1"])

    seen = sample.mapInArrow(counts, "word long, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    seen = seen.toArrow()  # at most WORDS rows
    shares = np.zeros((2, WORDS))
    word = np.asarray(seen.column("word"), dtype=np.int64)
    shares[0, word], shares[1, word] = np.asarray(seen.column("n0")), np.asarray(seen.column("n1"))
    sizes = dict(sample.groupBy("y").count().collect())
    n0, n1 = float(sizes.get(0, 0)), float(sizes.get(1, 0))
    kept = telling_words(shares.sum(axis=0), shares[1], n0 + n1, n1)
    place = np.full(WORDS, -1)
    place[kept] = np.arange(len(kept))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(WORDS, False)
        for batch in batches:
            out = []
            for k, text, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, sizes, _ = _instances([text], buckets)
                cell, sentence = shared.value[ids], np.repeat(np.arange(len(sizes)), sizes)
                out.append((k, cell[cell >= 0].astype(np.int32), sentence[cell >= 0].astype(np.int32), len(sizes), y))
            types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["k", "cell", "sentence", "n", "y"]
            )

    rows = sample.mapInArrow(instances, "k long, cell array<int>, sentence array<int>, n int, y int").orderBy("k", "y", "n").toArrow()
    n = np.asarray(rows.column("n"), dtype=np.int64)
    cell, sentence = (np.asarray(rows.column(c).combine_chunks().flatten(), dtype=np.int64) for c in ("cell", "sentence"))
    words = np.asarray([len(x) for x in rows.column("cell")], np.int64)
    return fit_sentences(kept, cell, sentence + np.repeat(np.cumsum(n) - n, words), n, np.asarray(rows.column("y"), dtype=np.int64))


def score_toxicity(
    docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``score``, and ``worst_start``, ``worst_end``, ``worst_score`` of the sentence that counts most.

    A text without sentences (null, empty) scores 0 and has no worst sentence. Of equal sentences the first
    is named. Repeated rows score alike, null ids are kept, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(WORDS, False)
        weights, bias = shared.value
        for batch in batches:
            for part in pieces(batch, 1):
                texts = part.column(1).to_pylist()
                ids, sizes, counts = _instances(texts, buckets)
                s, log_clean = _log_clean(weights, bias, ids, sizes)
                score = np.clip(-np.expm1(_sums(log_clean, counts)), 0, 1)
                ends, worst = np.cumsum(counts), []
                for i, text in enumerate(texts):
                    own = s[ends[i] - counts[i] : ends[i]]
                    if len(own):
                        at = int(own.argmax())
                        worst.append((*sentence_spans(text)[at], float(own[at])) if score[i] >= 0.5 else (None, None, float(own[at])))
                    else:
                        worst.append((None, None, None))
                begin, end, most = zip(*worst) if worst else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(most, pa.float64())],
                    ["doc_id", "score", "worst_start", "worst_end", "worst_score"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(scores, "doc_id long, score double, worst_start long, worst_end long, worst_score double")
