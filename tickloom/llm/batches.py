"""Walking Arrow batches of texts in pieces of bounded size, and hashing tokens to buckets, inside tasks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20
CACHED_TOKENS = 400_000
# Runs of letters, of digits, and of other visible characters.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about ``most`` bytes; a longer text is a slice of its own."""
    texts = batch.column(column)
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


class Buckets(dict):
    """Token to bucket, stable over processes. Words of capitals share a bucket: their shape is the signal."""

    def __init__(self, n: int, shapes: bool):
        super().__init__()
        self.n, self.shapes = n, shapes

    def __missing__(self, token: str) -> int:
        if len(self) > CACHED_TOKENS:
            self.clear()
        key = "\0capitals" if self.shapes and len(token) > 1 and token.isupper() else token.lower()
        self[token] = bucket = zlib.crc32(key.encode("utf-8", "replace")) % self.n
        return bucket

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all tokens, and how many each text has."""
        lists = [TOKEN.findall(t) if t else [] for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter((self[x] for row in lists for x in row), np.int64, int(sizes.sum()))
        return ids, sizes


def per_group(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of rows, zero for empty groups."""
    out = np.zeros((len(sizes), *values.shape[1:]), np.float64)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.add.reduceat(values, starts, axis=0)
    return out
