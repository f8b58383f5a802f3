"""SimHash near-dedup with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import NO_ID, cut_lineage, keyed_rows, lower_ascii, spaced, text_of, word_windows
from tickloom.llm.components import components

BITS = 64
# Bit b of byte value v, as counted below.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
DOCS_AT_ONCE = 2_000
# Further candidates of a similarity: texts of which BAND_ROWS smallest keyed hashes agree in one of BANDS bands.
BANDS, BAND_ROWS = 24, 6
BITMAP = 1_024  # bits that a set of shingles is spread over; where the bits of two sets differ, so do the sets


def _majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Majority bits per document: byte values are counted, then spread over their bits."""
    for whole in batches:
        for start in range(0, len(whole), DOCS_AT_ONCE):
            batch = whole.slice(start, DOCS_AT_ONCE)
            lists = batch.column(batch.num_columns - 1)
            ends = np.asarray(lists.offsets, dtype=np.int64)
            sizes = np.diff(ends)
            parts = np.asarray(lists.values, dtype=np.int64)[ends[0] : ends[-1]].astype(">i8").view(np.uint8).reshape(-1, 8)
            cell = np.repeat(np.arange(len(batch), dtype=np.int64) * 256, sizes)
            counts = [
                np.bincount(cell + parts[:, k], minlength=256 * len(batch)).reshape(-1, 256) @ BYTE_BITS for k in range(8)
            ]
            over = 2 * np.concatenate(counts, axis=1) > sizes[:, None]
            prints = np.packbits(over, axis=1).view(">i8").ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], [*batch.schema.names[:-1], "fp"])


def _shingled(docs: DataFrame, keys: list[Column], text: Column, shingle: int) -> DataFrame:
    """``keys``, and ``h``: hashes of the shingles of ``text``, repeats included."""
    split_up = docs.select(*keys, lower_ascii(spaced(text_of(text))).alias("t")).select(
        "*", word_windows(F.col("t"), shingle).alias("s")
    )
    whole = F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.array("t"))
    shingles = F.when(F.size("s") > 0, F.col("s")).otherwise(whole)
    return split_up.withColumn("h", F.transform(shingles, lambda x: F.xxhash64(x))).drop("t", "s")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id`` and the 64-bit fingerprint ``fp``: bit by bit the majority over the shingles' hashes.

    Shingles are ``shingle`` words joined by a space, repeats included; a shorter text is one shingle,
    a text without words (null, empty, blank) has fingerprint zero.
    """
    hashed = _shingled(docs, [F.col(id_col).cast("long").alias("doc_id")], F.col(text_col), shingle)
    return hashed.mapInArrow(_majority, "doc_id long, fp long")


def linked_prints(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints (column ``fp``) at ``max_bits`` or fewer differing bits.

    ``max_bits`` bits over ``max_bits // 2 + 1`` segments leave one segment with at most one of them. Every
    print is indexed under each whole segment, and looked up under each segment and each of its variants
    with one bit set, so two prints whose segment is equal or one bit apart meet by equality, once per
    segment. Candidates are verified on all bits. Both sides are exploded after they were last sized, so a
    planner that could choose would broadcast many times what it counted; they are always merged.
    """
    pieces = max_bits // 2 + 1
    cuts = [BITS * i // pieces for i in range(pieces + 1)]
    spans = [(i, cuts[i], cuts[i + 1] - cuts[i]) for i in range(pieces)]
    distinct = prints.select("fp").distinct()

    def part(lo: int, width: int):
        return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1))

    index = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("piece"), part(lo, n).alias("value")) for i, lo, n in spans])).alias("k")
    ).select(F.col("fp").alias("b"), "k.piece", "k.value")
    variants = [
        F.struct(F.lit(i).alias("piece"), part(lo, n).bitwiseOR(F.lit(1 << p)).alias("value"),
                 (part(lo, n).bitwiseAND(F.lit(1 << p)) == 0).alias("use"))
        for i, lo, n in spans for p in range(n)
    ]
    whole = [F.struct(F.lit(i).alias("piece"), part(lo, n).alias("value"), F.lit(True).alias("use")) for i, lo, n in spans]
    lookup = distinct.select("fp", F.explode(F.array(*whole, *variants)).alias("k")).filter("k.use").select(
        F.col("fp").alias("a"), "k.piece", "k.value"
    )
    return (
        lookup.hint("merge").join(index.hint("merge"), ["piece", "value"])
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id reachable over links, for every row.

    Documents with one fingerprint are one node, so copies cost nothing beyond their row. A null id is
    kept and never is the smallest of a group that has another. Repeated rows get equal results, ties
    do not arise, an empty table gives an empty one.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    lowest = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    grouped = components(linked_prints(lowest, max_bits), "a", "b")
    # Members of a component get its smallest document: first per node, then per component.
    node = lowest.join(grouped, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component")
    )
    best = node.groupBy("component").agg(F.min("low").alias("component_id"))
    named = node.join(best, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """After ``did`` and ``th``: the fingerprint, a hash of the set of shingles, its size, its bands and its bitmap."""
    slopes = _mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    for whole in batches:
        for start in range(0, len(whole), DOCS_AT_ONCE):
            batch = whole.slice(start, DOCS_AT_ONCE)
            prints = next(_majority(iter([batch]))).column(2)
            ends = np.asarray(batch.column(2).offsets, dtype=np.int64)
            hashes = np.asarray(batch.column(2).values, dtype=np.int64).view(np.uint64)
            sets, sizes, bands, bitmap = [], [], [], np.zeros((len(batch), BITMAP), bool)
            for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
                own = _mixed(np.unique(hashes[lo:hi]))
                sets.append(_mixed(own.sum(dtype=np.uint64) + np.uint64(len(own))))
                sizes.append(len(own))
                bitmap[i, own % np.uint64(BITMAP)] = True
                lowest = np.array([(own * m).min() for m in slopes]) if len(own) else np.zeros(len(slopes), np.uint64)
                spread = _mixed(lowest + slopes).reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64)
                bands.append(_mixed(spread + np.arange(BANDS, dtype=np.uint64)))

            def lists(values: np.ndarray) -> pa.Array:
                each = len(values) // len(batch)
                return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, each), pa.int32()), pa.array(values.view(np.int64)))

            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], prints, pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                 lists(np.concatenate(bands)), lists(np.packbits(bitmap, axis=1).ravel().view(np.int64))],
                ["did", "th", "fp", "node", "size", "bands", "bits"],
            )


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose sets of shingles have at least this Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("h").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("h").alias("hb"))
    shared = F.size(F.array_intersect("ha", "hb"))
    # Rounded so that 4 of 5 shingles are 0.8.
    share = F.round(shared / (F.size("ha") + F.size("hb") - shared), 12)
    return pairs.join(left, "a").join(right, "b").filter(share >= similarity).select("a", "b")


def similar_groups(rows: DataFrame, text: Column, shingle: int, max_bits: int, similarity: float) -> DataFrame:
    """``did``, ``th`` and ``group`` of each of the ``keyed_rows``; texts without words are one group.

    Candidates are fingerprints at ``max_bits`` or fewer bits and texts that share a band; each link is verified
    on the whole sets of shingles. In a crowd of one band all are first compared with its lowest; only crowds
    that are then of several groups are compared in pairs, and only between groups. Groups are those of all pairs.

    Pairs that share a band are told apart inside the join by their bitmaps: sets differ in at least as many
    shingles as their bitmaps do in bits, so a pair with too many such bits cannot be similar, and none that is
    similar is lost. What is left of a pair comes out of its lowest shared band alone.
    """
    hashed = _shingled(rows, [F.col("did"), F.col("th")], text, shingle)
    found = cut_lineage(
        hashed.mapInArrow(_banded, "did long, th long, fp long, node long, size long, bands array<long>, bits array<long>")
    )
    nodes = cut_lineage(found.filter("size > 0").groupBy("node").agg(
        F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min("bits").alias("bits"),
        F.min(F.struct("did", "th")).alias("key"),
    ))
    near = linked_prints(nodes, max_bits)
    # Keys that nodes share: bands, and the lower print of two that are linked.
    band = nodes.select("node", "size", F.explode("bands").alias("at"))
    prints = near.select(F.col("a").alias("fp"), F.col("a").alias("at")).union(near.select(F.col("b"), F.col("a")))
    prints = prints.union(nodes.select("fp", F.col("fp").alias("at"))).distinct()
    at = band.withColumn("of_print", F.lit(False)).union(
        nodes.join(prints, "fp").select("node", "size", F.xxhash64(F.lit("print"), "at"), F.lit(True))
    )
    crowds = at.groupBy("at").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("low")).filter("n > 1")
    shared = cut_lineage(at.join(crowds.select("at", "low"), "at"))
    fits = F.least("size", F.col("other")) >= F.greatest("size", F.col("other")) * (similarity - 1e-9)

    used = shared.select("node").distinct()
    keys = nodes.join(used, "node", "left_semi").select("node", "key.did", "key.th")
    texts = rows.join(keys, ["did", "th"]).dropDuplicates(["node"])
    sets = cut_lineage(_shingled(texts, [F.col("node")], text, shingle).select("node", F.array_distinct("h").alias("h")))

    first = shared.select(F.col("low.node").alias("a"), F.col("node").alias("b"), "size", F.col("low.size").alias("other"))
    links = cut_lineage(_similar(first.filter("a <> b").filter(fits).select("a", "b").distinct(), sets, similarity))
    named = components(links, "a", "b")
    placed = shared.join(named, "node", "left").select("at", "of_print", "node", "size", F.coalesce("component", "node").alias("part"))
    mixed = placed.groupBy("at").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("at")
    open_ = cut_lineage(placed.join(mixed, "at", "left_semi").join(nodes.select("node", "bands", "bits"), "node"))
    other = open_.select(
        "at", F.col("node").alias("b"), F.col("size").alias("other"), F.col("part").alias("part_b"),
        F.col("bands").alias("bands_b"), F.col("bits").alias("bits_b"),
    )
    apart = sum(F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(BITMAP // 64))
    most_apart = (F.col("size") + F.col("other")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    lowest_band = F.col("of_print") | (F.array_min(F.array_intersect("bands", "bands_b")) == F.col("at"))
    rest = open_.join(other, "at").filter(
        (F.col("node") < F.col("b")) & (F.col("part") != F.col("part_b")) & fits & (apart <= most_apart) & lowest_band
    )
    more = _similar(rest.select(F.col("node").alias("a"), "b").distinct(), sets, similarity)
    grouped = components(links.union(more), "a", "b")
    return found.join(grouped, "node", "left").select("did", "th", F.coalesce("component", "node").alias("group"))


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2,
    similarity: float | None = None,
) -> DataFrame:
    """``row`` for one input row of each group: the smallest id, of texts that share it the smallest hash.

    Null ids come last, so a group that has null ids only keeps one of its rows too. Groups under one id, or
    without any, each keep their own row; of repeated rows one stays. With a ``similarity`` the groups are
    those of ``similar_groups``.
    """
    rows = keyed_rows(docs, id_col, text_col)
    text = F.col(f"row.`{text_col}`")
    if similarity is not None:
        return _first_rows(rows, similar_groups(rows, text, shingle, max_bits, similarity))
    prints = cut_lineage(_shingled(rows, [F.col("did"), F.col("th")], text, shingle).mapInArrow(_majority, "did long, th long, fp long"))
    grouped = components(linked_prints(prints, max_bits), "a", "b")
    named = prints.join(grouped, F.col("fp") == F.col("node"), "left").withColumn("group", F.coalesce("component", "fp"))
    return _first_rows(rows, named)


def _first_rows(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``row`` of the first key (``did``, ``th``) of each ``group`` of ``named``, null ids last."""
    first = F.min(F.struct((F.col("did") == NO_ID).alias("none"), "did", "th"))
    keep = named.groupBy("group").agg(first.alias("key")).select("key.did", "key.th")
    return rows.join(keep, ["did", "th"], "left_semi").dropDuplicates(["did", "th"]).select("row")
