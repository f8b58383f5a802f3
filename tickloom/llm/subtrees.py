"""Substring dedup over words, with prefix-partitioned suffix trees.

The suffixes that matter are split by a prefix of variable length, from their start to the end of the
anchor of their first window, into groups that fit a task; a group that is too large gets longer prefixes.
Each group's suffix tree is grown from the root by whole levels, and nodes that reach the window length with
more than one leaf are the repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.batches import CACHED_TOKENS, pieces
from tickloom.llm.common import text_of
from tickloom.llm.repeats import Symbols, covered, mixed, repeated_windows

LENGTH = 35
GRAMS = (10, 23, 32, LENGTH)
CROWD = 2_048
LEAVES_AT_ONCE = 1_000_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_TOKENS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
        return h


_HASHES = WordHashes()


def _read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    rows = [WORD.findall(t) if t else [] for t in texts]
    sizes = np.array([len(r) for r in rows], np.int64)
    return np.fromiter((_HASHES[w] for r in rows for w in r), np.uint64, int(sizes.sum())), sizes


def deep_leaves(words: np.ndarray, leaves: np.ndarray, root: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes (positions ``leaves`` of ``words``) lie below a node at ``depth`` with several leaves.

    The trees, one per value of ``root``, grow a level at a time: the leaves below a node split by their next
    word. A leaf that is alone below a node can share nothing deeper and leaves the tree. A single child is
    the same node a word further down.
    """
    node = root.astype(np.uint64)
    alive = np.arange(len(leaves))
    for level in range(depth + 1):
        _, which, count = np.unique(node[alive], return_inverse=True, return_counts=True)
        alive = alive[count[which] > 1]
        if level == depth or not len(alive):
            break
        node[alive] = mixed(node[alive] * np.uint64(0x9E3779B97F4A7C15) + words[leaves[alive] + level])
    out = np.zeros(len(leaves), bool)
    out[alive] = True
    return out


def _marks(bodies: list[np.ndarray], group: np.ndarray) -> list[np.ndarray]:
    """Per stretch, which of its windows occur at another start of its group."""
    marks: list[np.ndarray] = [np.zeros(0, bool)] * len(bodies)
    order = np.argsort(group, kind="stable")
    starts = np.array([len(b) - LENGTH + 1 for b in bodies], np.int64)
    total = np.cumsum(starts[order])
    lo = 0
    while lo < len(order):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + LEAVES_AT_ONCE, "right"))
        hi = max(hi, lo + 1)
        while hi < len(order) and group[order[hi]] == group[order[hi - 1]]:  # groups stay whole
            hi += 1
        rows = order[lo:hi]
        sizes = np.array([len(bodies[r]) for r in rows])
        begin = np.cumsum(sizes) - sizes
        n = starts[rows]
        leaves = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        deep = deep_leaves(np.concatenate([bodies[r] for r in rows]), leaves, np.repeat(group[rows], n), LENGTH)
        for r, part in zip(rows, np.split(deep, np.cumsum(n)[:-1])):
            marks[r] = part
        lo = hi
    return marks


def _hashed(symbols: np.ndarray) -> np.ndarray:
    return symbols  # words are read as hashes


WORDS = Symbols(LENGTH, GRAMS, CROWD, np.uint64, _read, _hashed, _marks)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, batch.schema.get_field_index("body")):
            out = []
            for row, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "body", "spans"))):
                words = WORD.findall(text)
                gone = covered(spans, LENGTH, len(words)) if spans else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((row, len(words), len(words) - len(kept), " ".join(kept)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["doc_id", "n_words", "n_removed", "kept"]
            )


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (words left, joined by spaces) for every row.

    A word goes if a window of ``LENGTH`` words covers it that starts anywhere else too, in any document.
    Null and blank texts have no words; texts shorter than a window lose nothing. A repeated row is a document
    of its own, so it and its copy lose what they share. Null ids are kept, ties do not arise, an empty table
    gives an empty one.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("body")).select(
        F.xxhash64("doc_id", "body").alias("key"), "doc_id", "body"
    )
    spans = repeated_windows(base, WORDS)
    return base.join(spans, "key", "left").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")
