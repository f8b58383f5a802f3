"""Mixing sources to target weights with soft domain membership.

A classifier learned from a labelled table gives every document posteriors over domains. Document rates are
then the nonnegative least-squares fit of expected domain tokens to their targets, nearest to keeping documents
as they are, by Newton steps: k by k sums over the documents per step, whatever their number.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.batches import Buckets, per_group, pieces
from tickloom.llm.common import cut_lineage, keyed_rows, text_of

WORDS = 1 << 15  # buckets of words; with the number of domains this bounds what is collected and broadcast
# Most labelled rows that words are counted on and that the calibration is fitted on, by the hash of their id.
COUNTED_ROWS = 30_000
CALIBRATION_ROWS = 5_000
EVIDENCE = 3.0  # most that one word may say for or against a domain
DOUBT = 0.7  # evidence below this is chance more often than not and counts as none
SMOOTHING = 20.0
CLOSE = 1e-4  # gap of a domain, as a share of its own target, that counts as met
STRENGTHS = [10.0**e for e in range(2, 13)]  # weights of the gaps against moving rates, tried in turn
FIT_STRENGTH = 1e4  # least weight at which targets that no rates meet are left at their best fit
STEPS = 60  # most Newton steps per weight
SHORTER = 0.5 ** np.arange(0, 12, 2)  # step lengths tried together

log = logging.getLogger(__name__)


@dataclass
class DomainModel:
    """Evidence per word and domain, and a softmax over a document's scaled sums of it."""

    evidence: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def features(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = per_group(self.evidence[ids], sizes)
        return np.sign(total) * np.log1p(np.abs(total))

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _softmax_fit(x: np.ndarray, y: np.ndarray, domains: int, rounds: int = 400, rate: float = 0.05):
    w, b = np.zeros((domains, domains)), np.zeros(domains)
    if not len(y):
        return w, b
    model, onehot = DomainModel(np.zeros((0, domains)), w, b), np.eye(domains)[y]
    first = [np.zeros_like(w), np.zeros_like(b)]
    second = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        e = (model.posteriors(x) - onehot) / len(y)
        for i, (p, g) in enumerate(((model.weights, x.T @ e + 1e-4 * model.weights), (model.bias, e.sum(axis=0)))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            p -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return model.weights, model.bias


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: int, id_col: str = "doc_id", text_col: str = "text") -> DomainModel:
    """Model from ``labelled`` (``k`` id, ``y`` domain number).

    Words are counted per domain over at most ``COUNTED_ROWS`` from one half of the labelled documents, each
    task summing its own first; the softmax is calibrated on at most ``CALIBRATION_ROWS`` of the other half,
    which the counts have not seen. Both lists of ids are bounded, hence broadcast; no text is shuffled.
    """
    half = F.xxhash64(F.lit("half"), "k") % 2
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    usable = labelled.filter("k IS NOT NULL AND y IS NOT NULL")
    width = WORDS * domains

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = Buckets(WORDS, False), np.zeros(width, np.int64)
        for batch in batches:
            for part in pieces(batch, 1):
                ids, sizes = buckets.of_texts(part.column(1).to_pylist())
                total += np.bincount(ids * domains + np.repeat(np.asarray(part.column(2), dtype=np.int64), sizes), minlength=width)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])


    def chosen(part: int, most: int) -> DataFrame:
        return F.broadcast(usable.filter(F.abs(half) == part).orderBy(F.xxhash64("k"), "k", "y").limit(most))

    counted = texts.join(chosen(0, COUNTED_ROWS), "k").select("k", "text", "y").mapInArrow(counts, "cell long, n long")
    cells = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(width)
    table[np.asarray(cells.column("cell"), dtype=np.int64)] = np.asarray(cells.column("n"), dtype=np.float64)
    table = table.reshape(WORDS, domains)
    overall = (table.sum(axis=1) + 1e-9) / (table.sum() + 1e-9 * WORDS)
    within = (table + SMOOTHING * overall[:, None]) / np.maximum(table.sum(axis=0) + SMOOTHING, 1e-9)
    evidence = np.clip(np.log((within * table.sum() + SMOOTHING) / (overall[:, None] * table.sum() + SMOOTHING)), -EVIDENCE, EVIDENCE)
    evidence = np.sign(evidence) * np.maximum(np.abs(evidence) - DOUBT, 0)
    model = DomainModel(evidence, np.zeros((domains, domains)), np.zeros(domains))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(WORDS, False)
        for batch in batches:
            for part in pieces(batch, 1):
                x = model.features(*buckets.of_texts(part.column(1).to_pylist()))
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, domains, dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat, part.column(2)], ["k", "x", "y"])

    rows = (
        texts.join(chosen(1, CALIBRATION_ROWS), "k").select("k", "text", "y")
        .mapInArrow(features, "k long, x array<double>, y int").orderBy("k", "y").toArrow()
    )
    x = np.asarray(rows.column("x").combine_chunks().flatten(), dtype=np.float64).reshape(-1, domains)
    model.weights, model.bias = _softmax_fit(x, np.asarray(rows.column("y"), dtype=np.int64), domains)
    return model


def posteriors(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``did``, ``th`` (the key of ``keyed_rows``), ``tokens`` and the posteriors ``p`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    domains = len(model.bias)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(WORDS, False)
        for batch in batches:
            for part in pieces(batch, 2):
                ids, sizes = buckets.of_texts(part.column(2).to_pylist())
                p = shared.value.posteriors(shared.value.features(ids, sizes))
                flat = pa.ListArray.from_arrays(np.arange(0, p.size + 1, domains, dtype=np.int32), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), flat], ["did", "th", "tokens", "p"])

    base = keyed_rows(docs, id_col, text_col).select("did", "th", text_of(F.col(f"row.`{text_col}`")).alias("body"))
    return base.mapInArrow(score, "did long, th long, tokens long, p array<double>")


def _rate(prices: np.ndarray, max_rate: float | None) -> Column:
    """A document's rate under a price per domain: all it needs are its posteriors."""
    moved = F.lit(1.0) - sum(F.get("p", F.lit(k)) * F.lit(float(m)) for k, m in enumerate(prices))
    low = F.greatest(moved, F.lit(0.0))
    return low if max_rate is None else F.least(low, F.lit(float(max_rate)))


def price_sums(t: np.ndarray, p: np.ndarray, prices: np.ndarray, max_rate: float | None) -> np.ndarray:
    """A row per row of ``prices``: tokens per domain, the cost, the curvature, what documents pay at most, and the most of one token.

    These add up over parts of the documents, and the last one's maximum counts.
    """
    out = []
    top = np.inf if max_rate is None else max_rate
    for m in prices:
        cost = p @ m
        rate = np.clip(1 - cost, 0, top)
        free = (t * ((rate > 0) & (rate < top)))[:, None] * p
        gain = np.maximum(-cost, 0)
        out.append(np.concatenate([(t * rate) @ p, [t @ (0.5 * (rate - 1) ** 2 + cost * rate)], (free.T @ p).ravel(), [t @ gain, gain.max(initial=0.0)]]))
    return np.array(out)


def fit_prices(
    sums: Callable[[np.ndarray], np.ndarray], have: np.ndarray, target: np.ndarray, max_rate: float | None = None
) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Prices, tokens per domain under them, whether the targets are met, and if not, whether no rates can meet them.

    ``sums`` is ``price_sums`` over all documents. At a given strength the prices minimise a convex function,
    the dual of moving rates little and leaving small gaps; what it leaves shrinks as the strength grows. That
    no rates meet the targets is proven when the prices would pay more for the targets than any rates can earn.
    """
    k = len(have)
    real = (have > 0) & (target > 0)
    goal = np.where(have > 0, target, 0.0)

    def split(row: np.ndarray, m: np.ndarray, soft: np.ndarray):
        now, cost, curve = row[:k], row[k], row[k + 1 : -2].reshape(k, k)
        value = m @ goal - cost + 0.5 * (soft * m) @ m
        return now, value, goal - now + soft * m, curve + np.diag(np.where(have > 0, soft, 1.0))

    def met(now: np.ndarray) -> bool:
        return bool((np.abs(now - goal)[real] <= CLOSE * goal[real]).all() and (now[~real] <= CLOSE * goal.sum()).all())

    def beyond(row: np.ndarray, m: np.ndarray) -> bool:
        earned = row[-1] * goal.sum()
        return (earned if max_rate is None else min(earned, max_rate * row[-2])) < -(m @ goal) * (1 - 1e-9)

    m = np.zeros(k)
    row, impossible = sums(m[None, :])[0], False
    for strength in STRENGTHS:
        soft = have / strength
        for _ in range(STEPS):
            now, value, slope, curve = split(row, m, soft)
            if met(now):
                return m, now, True, False
            impossible = impossible or beyond(row, m)
            if (np.abs(slope) <= 0.1 * CLOSE * np.maximum(np.minimum(goal, have), 1e-9 * have.sum())).all():
                break
            step = -np.linalg.solve(curve, slope)
            tried = m + SHORTER[:, None] * step
            rows = sums(tried)
            values = np.array([split(r, x, soft)[1] for r, x in zip(rows, tried)])
            best = int(values.argmin())
            if values[best] >= value:
                break
            m, row = tried[best], rows[best]
        now = row[:k]
        if impossible and strength >= FIT_STRENGTH:
            break
    return m, now, met(now), impossible


def fit_rates(
    scored: DataFrame, weights: list[float], anchor: int | None = None, total_tokens: float | None = None,
    max_rate: float | None = None, headroom: float = 1.0,
) -> Column:
    """Rate of each row of ``scored``, such that expected tokens per domain are ``weights`` of the total.

    Among rates of zero or more (and at most ``max_rate``) that meet every target, those nearest to 1 are
    taken, documents weighing by their tokens. Where no rates meet them all, the sum of squared gaps, each
    divided by the tokens its domain has, is smallest, and a warning names what the domains get. A rate is one less
    the posteriors times a price per domain, within the bounds, so nothing is stored per document. The total is
    ``total_tokens``, or what keeps the tokens of the domain number ``anchor`` as they are, or else the
    largest that repeats no domain; ``headroom`` multiplies the latter two. With ``max_rate`` 1 and some
    headroom, documents of the anchor stay whole. Domains without tokens have no target; without any tokens
    every rate is 1.
    """
    k = len(weights)
    share = np.asarray(weights, float) / sum(weights)
    narrow = scored.select("tokens", "p")

    def sums(prices: np.ndarray) -> np.ndarray:
        def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(prices), k + k * k + 3))
            for batch in batches:
                p = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, k)
                part = price_sums(np.asarray(batch.column(0), dtype=np.float64), p, prices, max_rate)
                most = np.maximum(total[:, -1], part[:, -1])
                total += part
                total[:, -1] = most
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "x"])

        cells = narrow.mapInArrow(partly, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x"), F.max("x").alias("most")).toArrow()
        out = np.zeros((2, len(prices) * (k + k * k + 3)))
        out[:, np.asarray(cells.column("cell"))] = np.asarray(cells.column("x")), np.asarray(cells.column("most"))
        out = out.reshape(2, len(prices), -1)
        out[0, :, -1] = out[1, :, -1]
        return out[0]

    have = sums(np.zeros((1, k)))[0, :k]
    if have.sum() <= 0:
        return F.lit(1.0)
    present = have > 0
    whole = have / np.maximum(share, 1e-12)
    total = total_tokens or headroom * float(whole[anchor] if anchor is not None and present[anchor] else whole[present].min())
    prices, now, reached, impossible = fit_prices(sums, have, share * total, max_rate)
    if not reached:
        why = "no rates meet the targets" if impossible else "targets missed"
        log.warning("mixing: %s; tokens %s, targets %s", why, now.round(1).tolist(), (share * total).round(1).tolist())
    return _rate(prices, max_rate)


def mixed(
    docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text",
    anchor: str | None = None, total_tokens: float | None = None, max_rate: float | None = None, headroom: float = 1.0,
) -> DataFrame:
    """``did``, ``th``, ``tokens``, ``p`` and ``rate`` of every row of ``docs``.

    ``labelled`` has ``k`` (id) and ``domain``; domains outside ``targets``, null ids and repeated labels are
    allowed and only the named domains are learned. Null and empty texts have no tokens; their posteriors are
    those of a text without evidence. Repeated rows get equal rates. An empty table gives an empty table.
    """
    names = list(targets)
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("domain")).cast("int") - 1
    numbered = labelled.filter(F.col("domain").isin(names)).select("k", number.alias("y"))
    model = fit_domains(docs, numbered, len(names), id_col, text_col)
    scored = cut_lineage(posteriors(docs, model, id_col, text_col))
    rates = fit_rates(scored, [targets[n] for n in names], names.index(anchor) if anchor else None, total_tokens, max_rate, headroom)
    return scored.withColumn("rate", rates)


def drawn(docs: DataFrame, rates: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, each as often as its rate says: the whole part always, the rest by a draw keyed by id and text."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "did", "th"), 11).cast("double") / F.lit(float(1 << 53))
    rate = rates.groupBy("did", "th").agg(F.first("rate").alias("rate"))
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    rows = keyed_rows(docs, id_col, text_col).join(rate, ["did", "th"]).select("row", copies.alias("n"))
    return rows.filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), "n")).alias("copy")).select("row")
