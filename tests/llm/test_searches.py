"""Hard negatives, WARC archives and centroid clustering against plain versions, on awkward rows."""

import gzip
import hashlib
import math
import random
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import negatives, warc
from tickloom.llm.clusters import cluster, cluster_report, kept_vectors, nearest, squared
from tickloom.llm.negatives import bit_planes, hard_negatives, mining_rows, stacked_planes, subset_sums, table_scores
from tickloom.llm.warc import coalesced, open_archive, parse_record, read_records, record, with_payloads, write_warc

VECTORS = "vec_id long, embedding array<float>, label int, id string, v int, row int, cluster int, h string"


@pytest.fixture(scope="module")
def vector_rows():
    """Ties, copies, a repeated id, a null id, nulls, non-finite, empty, short and long vectors, one label for most."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)], 1 if i % 3 else i % 8) for i in range(400)]
    rows += [(500 + i, [0.5, -0.25] * 32, i % 4) for i in range(60)]
    rows += [(600, rows[0][1], 2), (600, rows[1][1], 2), (None, rows[2][1], 1), (650, [0.0] * 64, 1), (700, [0.1] * 63 + [None], 1)]
    rows += [(750, [0.1] * 63 + [math.inf], 1), (800, None, 1), (850, rows[3][1], None), (900, [], 1), (950, [0.3] * 5, 1)]
    rows += [(1000, [0.3] * 70, 2), (1001, [1e30] * 64, 1), (1050, [0.2] * 63 + [math.nan], 1), (-50, [-0.4] * 64, 77), (-100, [0.4] * 64, -3)]
    return rows


@pytest.fixture(scope="module")
def vector_table(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], VECTORS).repartition(5)

    return make


def whole(x, scale):
    return [math.floor(scale * float(np.float32(c))) for c in x]


def usable(x, scale):
    return x is not None and all(c is not None and math.isfinite(np.float32(c)) for c in x) and sum(c * c for c in whole(x, scale)) < 2**58


def plain_negatives(rows):
    part = [(NO if i is None else i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, whole(x, 256)) for i, x, y in rows if y is not None and usable(x, 256)]
    out = []
    for a, (aid, alabel, ax) in enumerate(part):
        if aid == NO or aid % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(ax, x)), i, y) for r, (i, y, x) in enumerate(part) if r != a)
        for s, i, _ in [t for t in scored if t[2] == alabel][:5]:
            good = [t for t in scored if t[2] != alabel and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(aid, None if i == NO else i, n + 1, None if t[1] == NO else t[1], -s, -t[0]) for n, t in enumerate(good)]
    return sorted(out, key=repr)


NO = -(2**63)
MOVED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def found_negatives(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in hard_negatives(mining_rows(df, label=MOVED)).select(*names).collect()), key=repr)


def test_hard_negatives(vector_table, vector_rows, monkeypatch):
    want = plain_negatives(vector_rows)
    assert len(want) > 20
    assert found_negatives(vector_table(vector_rows)) == want
    # Many small blocks give the same as a few large ones.
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(negatives, "BLOCK_CANDIDATES", 50)
    assert found_negatives(vector_table(vector_rows)) == want


def test_hard_negatives_of_little(vector_table):
    assert found_negatives(vector_table([])) == []
    assert found_negatives(vector_table([(0, [1.0] * 8, 1)])) == []
    assert found_negatives(vector_table([(1, [1.0] * 8, 1), (2, [1.0] * 8, 2)])) == []  # no anchor
    alone = [(50, [1.0] * 8, 1), (51, [1.0] * 8, 2)]
    assert found_negatives(vector_table(alone)) == plain_negatives(alone) == []
    # Negative and zero scores of positives: an empty band, and one that holds zero alone.
    edge = [(50, [1.0, 0.0], 1), (51, [-1.0, 0.0], 1), (52, [0.0, 1.0], 1), (53, [0.0, 2.0], 2), (54, [-0.9, 0.0], 2)]
    assert found_negatives(vector_table(edge)) == plain_negatives(edge)


def test_table_scores_are_inner_products():
    rng = np.random.default_rng(2)
    for dims, most in ((64, 256), (3, 1), (17, 2**26), (8, 0)):
        a, c = rng.integers(-most, most + 1, (40, dims)), rng.integers(-most, most + 1, (300, dims))
        planes = bit_planes(c)
        assert (table_scores(subset_sums(a, planes.shape[2], planes.shape[1]), planes) == c @ a.T).all()
    # Rows packed apart, with other bits and groups.
    x, y = rng.integers(-3, 4, (5, 4)), rng.integers(-9000, 9000, (6, 20))
    rows = [p.tobytes() for p in bit_planes(x)] + [p.tobytes() for p in bit_planes(y)]
    planes = stacked_planes(rows, np.array([1] * 5 + [3] * 6))
    a = rng.integers(-50, 50, (7, 20))
    want = np.vstack([np.pad(x, ((0, 0), (0, 16))), y]) @ a.T
    assert (table_scores(subset_sums(a, 3, planes.shape[1]), planes) == want).all()


# --- clustering ---


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, whole(x, 256)) for i, x, _ in rows if x is not None and len(x) == 64 and usable(x, 256)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((p - q) ** 2 for p, q in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        owner = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, o) in zip(kept, owner) if o == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    owner = assign()
    total = {n: sum(d for d, o in owner if o == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, total[n], sum(total.values()), digest[n]) for (i, _), (d, n) in zip(kept, owner)), key=repr)


def found_clusters(df, **how):
    return sorted((tuple(r) for r in cluster_report(cluster(kept_vectors(df), **how)).collect()), key=repr)


def test_clusters(vector_table, vector_rows):
    assert found_clusters(vector_table(vector_rows)) == plain_clusters(vector_rows)
    few = vector_rows[:7] + vector_rows[400:420]
    assert found_clusters(vector_table(few)) == plain_clusters(few)  # fewer vectors than centroids, many of them equal
    assert found_clusters(vector_table(few), k=3, rounds=2) == plain_clusters(few, 3, 2)


def test_clusters_of_nothing(vector_table):
    assert found_clusters(vector_table([])) == []
    assert found_clusters(vector_table([(1, None, 1), (2, [0.5] * 3, 1)])) == []


def test_pivots_prune_and_keep_ties():
    rng = np.random.default_rng(4)
    centers = rng.integers(-4000, 4000, (40, 64))
    x = centers[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 64))
    pivots = centers[:12]
    to = lambda rows: np.sqrt(np.stack([squared(rows, p) for p in pivots], axis=1).astype(float))
    doubled = np.vstack([centers, centers])
    owner, best, exact = nearest(x, to(x), doubled, to(doubled))
    d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (owner == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert exact < 0.15 * len(x) * len(doubled)


# --- archives ---

PAGES = "page_id long, url string, html string, row int, digest string, bytes int, file string, payload string"


@pytest.fixture(scope="module")
def page_rows():
    long_html = "<p>" + "ä long page " * 200_000
    rows = [(i, f"http://a.example/{i}", f"<html>{i} " + "x" * 200) for i in range(60)]
    rows += [(100 + i, f"http://b.example/{i}", "<p>" + "copied " * 40) for i in range(150)]
    rows += [(90, None, "<p>" + "copied " * 40), (91, "odd url\r\nWARC-Type: x é", "short"), (92, "u", "short"), (93, "u", None), (94, "u", "")]
    rows += [(95, "u", "y" * 99), (96, "u", "y" * 99), (97, "u", "y" * 100), (98, "u", "y" * 100), (99, "u", "é" * 50), (300, "u", "é" * 50)]
    rows += [(None, "u", "y" * 100), (None, "v", "only without an id " * 9), (None, "v", "only without an id " * 9)]
    rows += [(400, "u", long_html), (401, "w", long_html), (402, "u", "a\r\n\r\nWARC/1.1\r\n" * 30), (17, "u", f"<html>17 " + "x" * 200), (17, "u", f"<html>17 " + "x" * 200)]
    return rows


@pytest.fixture(scope="module")
def page_table(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "d", 2, "f", "p") for r in rows], PAGES).repartition(4)


def plain_warc(rows):
    groups, out = {}, []
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for n, i in enumerate(ids):
            again = n > 0 and len(payload) >= 100
            out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


FOUND = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archives_come_back(page_table, page_rows, monkeypatch):
    monkeypatch.setattr(warc, "HOT_DIGESTS", 1)
    archive = write_warc(page_table(page_rows))
    records = read_records(archive)
    assert sorted((tuple(r) for r in records.select(*FOUND).collect()), key=repr) == plain_warc(page_rows)
    texts = with_payloads(records).select("page_id", F.decode("payload", "UTF-8").alias("html")).collect()
    assert sorted(((r.page_id, r.html) for r in texts), key=repr) == sorted(((i, h or "") for i, _, h in page_rows), key=repr)
    # Files are plain gzip members: a reader that knows nothing of the index sees the same records.
    folder = urlparse(archive.folder).path
    index = archive.index.collect()
    whole_files = {f: open(f"{folder}/{f}", "rb").read() for f in {r.file for r in index}}
    assert sum(len(b) for b in whole_files.values()) == sum(r.length for r in index)
    for f, data in whole_files.items():
        assert gzip.decompress(data).count(b"WARC-Record-ID:") == sum(r.file == f for r in index)
    assert {r.page_id: r.digest for r in index if r.page_id == 400} == {400: hashlib.sha256(dict((i, h) for i, _, h in page_rows)[400].encode()).hexdigest()}


def test_chosen_records_only(page_table, page_rows, spark):
    written = write_warc(page_table(page_rows))
    archive = open_archive(spark, written.folder)
    some = read_records(archive, F.col("url").startswith("http://a.example/1") & (F.col("record_type") == "response"))
    assert sorted(r.page_id for r in some.collect()) == sorted([1, *range(10, 20)])
    assert read_records(archive, F.col("url") == "nowhere").count() == 0


def test_archive_of_nothing(page_table):
    archive = write_warc(page_table([]))
    assert archive.index.count() == 0 and read_records(archive).count() == 0


def test_coalesced_reads():
    ranges = [(0, 10), (10, 5), (40, 5), (200, 1), (201, 300), (501, 5)]
    assert list(coalesced(ranges, gap=25, most=100)) == [(0, 45, [0, 1, 2]), (200, 201, [3]), (201, 501, [4]), (501, 506, [5])]
    assert list(coalesced([])) == []


def test_records_that_were_cut_are_refused():
    data = record("http://x.example/", b"body", hashlib.sha256(b"body").hexdigest(), 5, 6, None)
    assert parse_record(data)["payload"] == b"body"
    for cut in (data[:-1], data[: len(data) - 9] + data[-4:]):
        with pytest.raises(ValueError):
            parse_record(cut)
    again = parse_record(record(None, b"body" * 50, "d", None, 6, (None, 3)))
    assert (again["payload"], again["payload_bytes"], again["refers_to"], again["first_row"], again["url"]) == (None, 200, None, 3, None)
