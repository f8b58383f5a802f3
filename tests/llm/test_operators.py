"""Operators of the subpackage against plain versions, on rows chosen to be awkward."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import prose
from tickloom.llm.common import NO_ID, keyed_rows
from tickloom.llm.components import components
from tickloom.llm.lines import dedup_lines
from tickloom.llm.rules import POLICIES, RULES, ablations, apply_policy, mask_of, rule_ledger
from tickloom.llm.simhash import linked_prints, near_groups, one_of_each, similar_groups
from tickloom.llm.subtrees import dedup_words
from tickloom.llm.suffixes import dedup_bytes, suffix_arrays
from tickloom.llm.topk import cover_tree, integer_vectors, top_k


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_line_dedup(docs_of, odd_docs):
    done = dedup_lines(docs_of(odd_docs))
    found = got(done, "row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    assert found == sorted(brute.lines(odd_docs))


def test_line_dedup_threshold_and_repeats(docs_of):
    rows = [(1, "a shared long line\nown line of one"), (1, "a shared long line\nown line of one"), (2, "a shared long line"), (3, "own line of one")]
    three = dedup_lines(docs_of(rows), min_docs=3).select("row.doc_id", "n_dropped").collect()
    assert sorted(map(tuple, three)) == [(1, 0), (1, 0), (2, 0), (3, 0)]
    two = dedup_lines(docs_of(rows)).select("row.doc_id", "n_dropped").collect()
    assert sorted(map(tuple, two)) == [(1, 0), (1, 0), (2, 1), (3, 1)]


def test_near_groups(docs_of, odd_docs):
    found = got(near_groups(docs_of(odd_docs)), "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert found == sorted(brute.near_groups(odd_docs))


def test_one_of_each_keeps_one_row(docs_of, odd_docs):
    docs = docs_of([*odd_docs, (8, brute_text := dict(odd_docs)[8]), (None, brute_text), (None, "alone without an id")])
    kept = [r[0] for r in one_of_each(docs).select("row.doc_id").collect()]
    lowest = {c for _, _, c in brute.near_groups(odd_docs)}
    assert sorted(k for k in kept if k is not None) == sorted(lowest)
    assert kept.count(None) == 1


def test_one_of_each_keeps_a_row_of_every_group(docs_of):
    """Different texts without an id, or under one id, are groups of their own."""
    rows = [(None, prose(1, 60)), (None, prose(2, 60)), (None, prose(2, 60)), (5, prose(3, 60)), (5, prose(4, 60)), (6, prose(4, 60)), (7, prose(1, 60))]
    kept = sorted(tuple(r) for r in one_of_each(docs_of(rows)).select(F.coalesce("row.doc_id", F.lit(-1)), "row.text").collect())
    assert kept == sorted([(-1, prose(2, 60)), (5, prose(3, 60)), (5, prose(4, 60)), (7, prose(1, 60))])


def test_near_copies_by_shared_shingles(docs_of):
    """Groups of the stage against all pairs: changed words that leave from 0.6 to 0.95 of the shingles."""
    random.seed(9)
    rows, i = [], 0
    for base in range(60):
        words = prose(900 + base, 150).split()
        rows.append((i, " ".join(words)))
        for changes in (0, 1, 2, 4, 8):
            copy = list(words)
            for spot in random.sample(range(150), changes):
                copy[spot] = f"other{i}x{spot}"
            i += 1
            rows.append((i, " ".join(copy)))
        i += 1
    rows += [(5000, ""), (5001, None), (5002, "one two"), (5003, "one two"), (None, "quite alone here with five words")]
    sets = [{" ".join(w[j : j + 5]) for j in range(len(w) - 4)} or ({" ".join(w)} if w else {""}) for w in ((t or "").split() for _, t in rows)]
    pairs = [(x, y) for x in range(len(rows)) for y in range(x) if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    docs = docs_of(rows)
    found = {(r.did, r.group) for r in similar_groups(keyed_rows(docs, "doc_id", "text"), F.col("row.text"), 5, 3, 0.8).collect()}
    group = dict(found)
    ids = [NO_ID if d is None else d for d, _ in rows]
    assert sum(group[ids[x]] == group[ids[y]] for x, y in pairs) >= 0.99 * len(pairs)
    part = list(range(len(rows)))
    for x, y in sorted(pairs, key=lambda p: (p[1], p[0])) * 3:
        part[x] = part[y] = min(part[x], part[y])
    apart = [(x, y) for x in range(len(rows)) for y in range(x) if part[x] != part[y]]
    assert not any(group[ids[x]] == group[ids[y]] for x, y in apart)
    kept = one_of_each(docs, shingle=5, max_bits=3, similarity=0.8)
    assert kept.count() == len(set(group.values()))


def test_links_are_exactly_the_close_prints(spark):
    random.seed(4)
    prints = [random.getrandbits(64) for _ in range(30)]
    prints += [p ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for p in prints for _ in range(4)] + [0, 3, 2**64 - 1]
    signed = sorted({p - 2**64 if p >= 2**63 else p for p in prints})
    links = {tuple(r) for r in linked_prints(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert links == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}


@pytest.mark.parametrize("max_bits", [2, 3])
def test_exploded_prints_are_never_broadcast(spark, max_bits):
    """Some 33 rows a print: a table of prints below the threshold would pass through the driver many times as large."""
    links = linked_prints(spark.range(500).select(F.xxhash64("id").alias("fp")), max_bits)
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components(path, "a", "b").collect()}
    assert all(found.get(i, i) == 0 for i in range(61)) and found[101] == 100


def test_rules(docs_of, odd_docs):
    ledger = rule_ledger(docs_of(odd_docs))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert got(ledger, "doc_id", *names) == sorted((d, *brute.rules(t)) for d, t in odd_docs)
    judged = {r.doc_id: r for r in apply_policy(ledger, "v2").collect()}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in judged.values())
    assert not judged[17].kept and judged[8].kept
    table = {r.rule: r for r in ablations(ledger, "v2").collect()}
    bits = [r.fail_bits for r in judged.values()]
    for rule in POLICIES["v2"]:
        assert table[rule].n_failed == sum(b & mask_of((rule,)) > 0 for b in bits)
        assert table[rule].n_only == sum(b == mask_of((rule,)) for b in bits)
    assert mask_of(tuple(RULES)) == 2 ** len(RULES) - 1


def test_byte_dedup(docs_of, odd_docs):
    found = got(dedup_bytes(docs_of(odd_docs)), "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert found == sorted(brute.byte_dedup(odd_docs))


def test_word_dedup(docs_of, odd_docs):
    found = got(dedup_words(docs_of(odd_docs)), "doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert found == sorted(brute.word_dedup(odd_docs))


@pytest.mark.parametrize("module", ["suffixes", "subtrees"])
def test_crowded_groups_are_cut_anew(docs_of, odd_docs, module, monkeypatch):
    """With a crowd of one, every contested stretch takes the way of longer grams."""
    import importlib
    from dataclasses import replace

    m = importlib.import_module(f"tickloom.llm.{module}")
    name, run, plain, columns = {
        "suffixes": ("BYTES", dedup_bytes, brute.byte_dedup, ("doc_id", "n_bytes", "n_removed", "n_spans")),
        "subtrees": ("WORDS", dedup_words, brute.word_dedup, ("doc_id", "n_words", "n_removed")),
    }[module]
    monkeypatch.setattr(m, name, replace(getattr(m, name), crowd=1))
    assert got(run(docs_of(odd_docs)), *columns, F.sha2("kept", 256)) == sorted(plain(odd_docs))


def test_suffix_arrays():
    rng = np.random.default_rng(5)
    for _ in range(60):
        texts = [rng.integers(0, rng.integers(1, 5) + 1, rng.integers(1, 50)) for _ in range(rng.integers(1, 6))]
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size) - size
        order = suffix_arrays(np.concatenate(texts).astype(np.int16), begin, size)
        for b, t in zip(begin, texts):
            t = t.tolist()
            assert (order[b : b + len(t)] - b).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def vectors(spark, n=700):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 8))
    rows = [(i, (centers[i % 12] + 0.05 * rng.normal(size=8)).tolist(), 0) for i in range(n)]
    rows += [(n + i, rows[3][1], 1) for i in range(250)]  # equal vectors: ties
    rows += [(2000, None, 0), (2100, [1.0, None] + [0.0] * 6, 0), (2200, [math.nan] * 8, 0), (2300, [math.inf] * 8, 0), (2400, [], 0)]
    rows += [rows[0], (None, rows[1][1], 0), (2500, [0.0] * 8, 0), (2600, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_top_k(spark, monkeypatch):
    from tickloom.llm import topk

    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    ready = integer_vectors(vectors(spark))
    rows = [(r.id, list(r.v)) for r in ready.collect()]
    assert {r[0] for r in rows} >= {0, 2500, 2600} and not {r[0] for r in rows} & {2000, 2100, 2200, 2300, 2400}
    padded = [(i, v + [0] * (8 - len(v))) for i, v in rows]
    assert {tuple(r) for r in top_k(ready).collect()} == brute.top_k(padded)


def test_top_k_of_few_rows(spark):
    two = integer_vectors(spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], "vec_id long, embedding array<double>, label int"))
    assert [tuple(r) for r in top_k(two).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert top_k(two.filter("id > 5")).collect() == [] and top_k(two.filter("id = 0")).collect() == []


def test_cover_tree_covers():
    points = np.random.default_rng(1).normal(size=(500, 3))
    tree, order = cover_tree(points)
    stack, leaves = [tree], 0
    while stack:
        node = stack.pop()
        gap = np.sqrt(((points[order[node.lo : node.hi]] - node.center) ** 2).sum(axis=1))
        assert gap.max() <= node.radius + 1e-9
        assert all(c.radius <= node.radius / 2 + 1e-9 for c in node.children)
        leaves += 0 if node.children else node.hi - node.lo
        stack += node.children
    assert leaves == len(points) and sorted(order) == list(range(len(points)))


@pytest.mark.parametrize("name", ["lines", "near", "rules", "bytes", "words"])
def test_empty_tables(docs_of, spark, name):
    empty = docs_of([(1, "x")]).filter("doc_id > 1")
    run = {"lines": dedup_lines, "near": near_groups, "rules": rule_ledger, "bytes": dedup_bytes, "words": dedup_words}[name]
    assert run(empty).count() == 0


@pytest.mark.parametrize("name", ["near", "rules", "bytes", "words"])
def test_null_ids_and_repeated_rows_stay(docs_of, name):
    rows = [(None, "some text"), (None, None), (3, "some text"), (3, "some text")]
    run = {"near": near_groups, "rules": rule_ledger, "bytes": dedup_bytes, "words": dedup_words}[name]
    assert sorted(str(r.doc_id) for r in run(docs_of(rows)).select("doc_id").collect()) == ["3", "3", "None", "None"]
