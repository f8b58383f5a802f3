"""NumPy kernels over chunks of tick sequences, on Arrow batches.

Some causal quantities need a state that no window frame has: a window bounded by rows and by clock at once, or a
sorted window that is updated row by row. The sequence is cut into chunks and the neighbouring rows are copied
as in :mod:`tickloom.operators.frames`; a task then walks its sorted batches and runs the kernel on whole
chunks, many short ones at a time, so that neither a busy symbol nor thousands of quiet ones are slow.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.frames import CHUNK_ROWS, spread_over_chunks


@dataclass
class Stretch:
    """Whole chunks one after the other, each sorted by sequence. ``starts`` are their first rows."""

    table: pa.Table
    starts: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        """For each row the end of its chunk."""
        stops = np.append(self.starts[1:], self.table.num_rows)
        return np.repeat(stops, stops - self.starts)

    def floats(self, name: str) -> np.ndarray:
        """Values with NaN where there is none."""
        return self.table[name].to_numpy().astype(float)

    def ints(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy().astype(np.int64)


Kernel = Callable[[Stretch], dict[str, np.ndarray | pa.Array]]


def _starts(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Rows at which any of ``names`` changes; the first row is one."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in names:
        codes = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def over_chunks(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    kernel: Kernel,
    outputs: dict[str, T.DataType],
    *,
    before: int = 0,
    after: int = 0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``df`` with the columns ``outputs`` that ``kernel`` returns for the rows of each stretch.

    Every row sees ``before`` earlier and ``after`` later rows of its key, as in ``over_rows``. NaN in a
    result is NULL. A task holds the chunks that one Arrow batch touches, never a whole symbol.
    """
    spread = spread_over_chunks(df, keys, seq, before=before, after=after, chunk_rows=chunk_rows)
    ordered = spread.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", seq)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in outputs.items()]])
    given = df.columns

    def finished(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        made = kernel(Stretch(table, starts))
        home = pa.array(table["_home"].to_numpy() == table["_chunk"].to_numpy())
        out = table.select(given)
        for name in outputs:
            column = made[name] if isinstance(made[name], pa.Array) else pa.array(made[name], from_pandas=True)
            out = out.append_column(name, column)
        yield from out.filter(home).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            starts = _starts(pa.Table.from_batches([batch]), [*keys, "_chunk"])
            if len(held) > 1 and len(starts) == 1 and _starts(pa.Table.from_batches([held[-2].slice(held[-2].num_rows - 1), batch.slice(0, 1)]), [*keys, "_chunk"]).size == 1:
                continue  # the chunk goes on
            table = pa.Table.from_batches(held)
            starts = _starts(table, [*keys, "_chunk"])
            if len(starts) > 1:
                yield from finished(table.slice(0, starts[-1]), starts[:-1])
                held = table.slice(starts[-1]).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from finished(table, _starts(table, [*keys, "_chunk"]))

    return ordered.mapInArrow(run, schema)


def last_in_time(times: np.ndarray, ends: np.ndarray, max_rows: int, max_us: int) -> np.ndarray:
    """For each row the end of the rows after it that are within both bounds, by bisection along all rows at once."""
    low = np.arange(len(times)) + 1
    high = np.minimum(low + max_rows, ends)
    deadline = times + max_us
    low = np.minimum(low, high)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        inside = open_ & (times[np.minimum(middle, len(times) - 1)] <= deadline)
        high = np.where(open_ & ~inside, middle, high)
        low = np.where(inside, middle + 1, low)
    return low


def window_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of ``values[first:last]`` for each row, infinity if that is empty: two overlapping powers of two cover it."""
    length = np.maximum(last - first, 0)
    level = np.frexp(np.maximum(length, 1))[1] - 1
    out = np.full(len(first), np.inf)
    minima = values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            minima = np.minimum(minima[:-half], minima[half:]) if len(minima) > half else minima[:0]
        own = (level == k) & (length > 0)
        out[own] = np.minimum(minima[first[own]], minima[last[own] - (1 << k)])
    return out


def prior_order_statistics(values: np.ndarray, starts: np.ndarray, size: int, places: dict[str, int]) -> dict[str, np.ndarray]:
    """The ``places`` (from 0) of the sorted ``size`` values before each row of its chunk.

    One sorted window is kept and updated by each row. NaN until there are ``size`` rows and while one of
    them is NaN.
    """
    out = {name: np.full(len(values), np.nan) for name in places}
    given = values.tolist()
    absent = np.isnan(values).tolist()
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(given)]):
        window: list[float] = []
        for i in range(start, end):
            if i - start >= size:
                if len(window) == size:
                    for name, place in places.items():
                        out[name][i] = window[place]
                if not absent[i - size]:
                    del window[bisect_left(window, given[i - size])]
            if not absent[i]:
                insort(window, given[i])
    return out
