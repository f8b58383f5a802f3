"""Learned operators: held-out accuracy, targets met, exact round trips; and the registered queries."""

import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import prose
from tests.oracle import compare, connect
from tickloom.llm import components, simhash
from tickloom.llm.mixing import drawn, fit_rates, mixed
from tickloom.llm.pieces import MODEL, Vocabulary, _mixed, _skipped, decode, encode
from tickloom.llm.quality import score_quality
from tickloom.llm.queries import ORACLES, QUERIES
from tickloom.llm.toxicity import fit_toxicity, score_toxicity, sentence_spans

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
needs_model = pytest.mark.skipif(not os.path.isfile(MODEL), reason="tokenizer file not present")


@pytest.fixture(scope="module")
def labelled(spark, docs_of):
    rows = [(i, prose(i, 60) + (" !! $$$ ### !! " * 12 if i % 3 == 0 else "")) for i in range(300)]
    rows = [(i, t + (". you idiot clown. fine again." if i % 5 == 0 else ". quite fine.")) for i, t in rows]
    labels = [(i, int(i % 3 != 0), int(i % 5 == 0)) for i, _ in rows] + [(None, 1, 0), (4, None, None), (99999, 1, 1)]
    odd = [(1000, None), (1001, ""), (None, prose(3, 20)), (5, rows[5][1])]
    return docs_of([*rows, *odd]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    rows = score_quality(docs, labels).select("row.doc_id", "score").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 != 0) for r in held]) > 0.95


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    rows = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 5 == 0) for r in held]) > 0.95
    text = {r.doc_id: r.text for r in docs.collect()}
    worst = [text[r.doc_id][r.worst_start : r.worst_end] for r in rows if r.score >= 0.5]
    assert worst and all("idiot" in w or "clown" in w for w in worst)
    assert all(r.score == 0 and r.worst_score is None for r in rows if not text[r.doc_id])
    assert sentence_spans("a. b!\n\nc") == [(0, 2), (2, 5), (7, 8)]


def test_models_without_labels(labelled):
    docs, labels = labelled
    few = docs.filter("doc_id < 20 OR doc_id IS NULL")
    none = labels.filter("doc_id = -1")
    assert {r.score for r in score_quality(few, none).collect()} == {0.5}
    assert all(0 <= r.score < 0.5 for r in score_toxicity(few, fit_toxicity(few, none)).collect())
    assert score_quality(docs.filter("doc_id = -1"), labels).count() == 0


def test_mixing_meets_its_targets(labelled):
    docs, labels = labelled
    domain = F.when(F.col("quality") == 0, "poor").otherwise("clean")
    table = labels.select(F.col("doc_id").alias("k"), domain.alias("domain"))
    rates = mixed(docs, table, {"clean": 0.8, "poor": 0.2}, anchor="clean").toPandas()
    weight = rates.tokens * rates.rate
    share = (weight * rates.p.str[1]).sum() / weight.sum()
    assert (rates.rate >= 0).all() and abs(share - 0.2) < 0.01
    capped = mixed(docs, table, {"clean": 0.8, "poor": 0.2}, anchor="clean", max_rate=1.0, headroom=1.1)
    kept = [r[0] for r in drawn(docs, capped).select("row.doc_id").collect()]
    assert {i for i in range(300) if i % 3} <= set(kept) and len(kept) < docs.count()
    assert mixed(docs.filter("doc_id = -1"), table, {"clean": 0.8, "poor": 0.2}).count() == 0


def soft_documents(own: float, n: int = 6000):
    """Tokens and posteriors of documents, about ``own`` of each for its own domain."""
    rng = np.random.default_rng(8)
    base = np.full((n, 3), (1 - own) / 2)
    base[np.arange(n), rng.choice(3, n, p=(0.6, 0.25, 0.15))] = own
    p = rng.gamma(base * 8)
    return rng.integers(1, 2000, n), p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize(("own", "weights"), [(0.7, [0.75, 0.15, 0.10]), (0.5, [0.75, 0.15, 0.10]), (0.7, [0.9, 0.05, 0.05])])
def test_mixing_meets_each_target_with_soft_posteriors(spark, own, weights):
    tokens, p = soft_documents(own)
    scored = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, p array<double>")
    rate = np.array([r[0] for r in scored.select(fit_rates(scored, weights, anchor=0)).collect()])
    now = (tokens * rate) @ p
    assert (rate >= 0).all() and np.abs(now / now.sum() / weights - 1).max() < 1e-3
    assert now[0] == pytest.approx((tokens @ p)[0], rel=1e-3)


def test_mixing_tells_of_targets_out_of_reach(spark, caplog):
    tokens, p = soft_documents(0.7)
    scored = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, p array<double>")
    fit_rates(scored, [0.75, 0.15, 0.10], anchor=0, max_rate=1.0, headroom=1.05)
    assert "no rates meet the targets" in caplog.text


@needs_model
def test_pieces_without_dropout_are_the_models_own(odd_docs):
    import sentencepiece

    model, vocabulary = sentencepiece.SentencePieceProcessor(model_file=MODEL), Vocabulary.load(MODEL)
    texts = [t for _, t in odd_docs if t and "▁" not in t] + [" lead", "trail  ", "a b", "日本語 text"]
    ids, counts = vocabulary.encode_texts(texts, np.arange(len(texts)), 0.0, 0)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [model.encode(t) for t in texts]


@needs_model
def test_pieces_decode_to_the_text(docs_of, odd_docs):
    docs = docs_of([*odd_docs, (None, "no id"), (8, dict(odd_docs)[8])])
    plain = {(r.doc_id, r.n_pieces) for r in encode(docs, dropout=0.0).collect()}
    for seed in (0, 1):
        rows = encode(docs, dropout=0.3, seed=seed)
        assert rows.filter("NOT lossless").count() == 0
        texts = {r.doc_id: r.text for r in decode(rows).collect()}
        assert texts == {d: t or "" for d, t in [*odd_docs, (None, "no id")]}
        assert rows.filter("doc_id = 7").first().n_pieces > max(n for d, n in plain if d == 7)
    first, again, other = (encode(docs, dropout=0.3, seed=s).filter("doc_id = 7").first().ids for s in (0, 0, 1))
    assert first == again != other


@needs_model
def test_every_occurrence_draws_by_its_own_key():
    v = Vocabulary.load(MODEL)
    n, word = 4000, " unbelievable internationalization"
    ids, counts = v.encode_texts([word.strip()] * n, np.arange(n), 0.3, 1)
    ends = np.cumsum(counts)
    assert len({tuple(ids[e - c : e].tolist()) for e, c in zip(ends, counts)}) > 400
    merge = np.ones(1, np.int64)
    assert abs(np.mean([_skipped(np.array([k]), merge, merge, 0.1)[0] for k in _mixed(np.arange(n).astype(np.uint64))]) - 0.1) < 0.02


@needs_model
def test_cached_cuts_equal_cuts_encoded_one_by_one():
    v = Vocabulary.load(MODEL)
    rng = np.random.default_rng(6)
    names = list({" " + "".join(rng.choice(list("abcdehnostrié"), rng.integers(1, 90))) for _ in range(60)}) + [" the", " and", " there"]
    codes = rng.integers(0, len(names), 1500)
    own = rng.integers(0, 2**63, len(codes)).astype(np.uint64)
    ids, counts, which = v._dropped(names, codes, own, 0.1)
    begin = np.cumsum(counts) - counts
    plain, sizes = v.with_bytes(*v.encode_cuts([names[c] for c in codes], own, 0.1))
    first = np.cumsum(sizes) - sizes
    assert all(ids[begin[w] : begin[w] + counts[w]].tolist() == plain[f : f + n].tolist() for w, f, n in zip(which, first, sizes))
    assert which.max() + 1 < len(codes)


@needs_model
def test_long_cuts_take_the_same_merges():
    v = Vocabulary.load(MODEL)
    rng = np.random.default_rng(3)
    for k in range(40):
        s = "".join(rng.choice(list("abcdehnostr in"), rng.integers(2, 60)))
        symbols, key = v.of_char[[ord(c) for c in s]], np.array([k], np.uint64)
        assert v.encode_equal(symbols[None, :], key, 0.3)[0][1][0].tolist() == v.encode_long(symbols, key, 0.3).tolist()


@needs_tables
@needs_model
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    if name in ORACLES:
        assert compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF) is None
    else:
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@needs_tables
@needs_model
def test_pipeline_stages_on_odd_rows(docs_of, odd_docs, tmp_path):
    docs = docs_of([*odd_docs, (None, "no id"), (8, dict(odd_docs)[8])])
    spark = docs.sparkSession
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.count() <= docs.count()
        docs = out
    assert docs.filter("NOT lossless").count() == 0


def test_near_dedup_broadcasts_nothing_exploded(spark, docs_of, odd_docs, monkeypatch):
    """What is exploded after it was sized is many times as large, so no broadcast of the stage may hold it."""
    cut, plans = components.cut_lineage, []

    def watched(df):
        done = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return done

    monkeypatch.setattr(components, "cut_lineage", watched)
    monkeypatch.setattr(simhash, "cut_lineage", watched)
    corpus_pipeline.near_dedup(spark, docs_of(odd_docs), SF).collect()
    assert any("Generate explode" in p for p in plans)
    for lines in (p.split("\n") for p in plans):
        for i, line in enumerate(lines):
            if "BroadcastExchange" not in line:
                continue
            at, sized = len(re.match(r"[^A-Za-z]*", line)[0]), 10**9
            for below in lines[i + 1 :]:
                depth = len(re.match(r"[^A-Za-z]*", below)[0])
                if depth <= at:
                    break
                sized = 10**9 if depth <= sized else sized
                if sized == 10**9 and " Exchange " in below.replace("- ", "  "):
                    sized = depth
                assert sized < depth or "Generate explode" not in below, below


@needs_tables
@needs_model
def test_pipeline_runs(spark):
    left = corpus_pipeline.run(spark, SF)
    assert 0 < left.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
    assert left.filter("NOT lossless").count() == 0
