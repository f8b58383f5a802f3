"""Suffix-array dedup of byte strings, with suffix arrays from linear grouping construction.

The strings of a group are joined into one text. Its suffixes are first sorted into groups by their Lyndon
prefix, groups being taken in descending order: each member points at the previous suffix of a smaller group,
and the suffixes pointed at move to a higher group of their own. Then the order within groups follows in one
ascending pass over the placed suffixes. Nothing is renamed and sorted again. Many texts advance together,
one group of each per step, because that is what array operations are good at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.batches import pieces
from tickloom.llm.common import text_of
from tickloom.llm.repeats import Symbols, covered, mixed, repeated_windows

LENGTH = 200
GRAMS = (50, 125, 185, LENGTH)
CROWD = 16
TEXTS_AT_ONCE = 4_096
BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def group_suffixes(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of each text sorted into Lyndon-prefix groups.

    Texts lie one after the other in ``text``. Returned: suffixes by slot, each suffix's group (its first
    slot), and each suffix's previous suffix of a smaller group (-1 where its text has none).
    """
    n = len(text)
    lane = np.repeat(np.arange(len(begin)), size)
    slots = np.lexsort((text, lane))
    group = np.empty(n, np.int64)
    head = np.ones(n, bool)
    head[1:] = (text[slots[1:]] != text[slots[:-1]]) | (lane[slots[1:]] != lane[slots[:-1]])
    group[slots] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slot = np.empty(n, np.int64)
    slot[slots] = np.arange(n)
    width = np.zeros(n, np.int64)
    starts = np.flatnonzero(head)
    width[starts] = np.diff(np.append(starts, n))
    before = np.full(n, -1, np.int64)
    left_end = begin[lane]
    moved = np.zeros(n, bool)
    top = begin + size  # slots from here on are done, per text
    live = np.flatnonzero(size > 0)
    while len(live):
        first = group[slots[top[live] - 1]]
        members = slots[_ranges(first, top[live] - first)]
        own = np.repeat(first, top[live] - first)
        # Previous smaller: hop over suffixes of groups already done, and step over those of the same group.
        at = members - 1
        open_ = np.flatnonzero(at >= left_end[members])
        while len(open_):
            p = at[open_]
            higher = group[p] >= own[open_]
            open_, p = open_[higher], p[higher]
            at[open_] = np.where(group[p] > own[open_], before[p], p - 1)
            open_ = open_[at[open_] >= left_end[members[open_]]]
        before[members] = np.where(at >= left_end[members], at, -1)
        top[live] = first
        live = live[first > begin[live]]
        targets = before[members]
        targets = targets[targets >= 0]
        if not len(targets):
            continue
        targets, count = np.unique(targets, return_counts=True)
        # Those pointed at leave their group upwards, by how many members point at them.
        old = group[targets]
        by = np.lexsort((count, old))
        targets, count, old = targets[by], count[by], old[by]
        edge = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        leaving = np.diff(np.append(edge, len(old)))
        tail = old[edge] + width[old[edge]] - leaving
        new_slots = _ranges(tail, leaving)
        moved[targets] = True
        there = slots[new_slots]
        stay = there[~moved[there]]
        free = slot[targets]
        free = free[free < np.repeat(tail, leaving)]
        moved[targets] = False
        slots[free], slot[stay] = stay, free
        slots[new_slots], slot[targets] = targets, new_slots
        width[old[edge]] -= leaving
        part = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (count[1:] != count[:-1])))
        lengths = np.diff(np.append(part, len(old)))
        width[new_slots[part]] = lengths
        group[targets] = np.repeat(new_slots[part], lengths)
    return slots, group, before


def order_groups(group: np.ndarray, before: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Final order from the groups: placing a suffix places those whose next smaller suffix it is."""
    n = len(group)
    order = np.full(n, -1, np.int64)
    free = np.arange(n)
    placed = np.zeros(n, bool)
    lanes = np.flatnonzero(size > 0)
    turn = begin[lanes].copy()  # next slot to read
    chain = begin[lanes] + size[lanes] - 1  # the empty suffix comes first: it places the last one
    low = begin[lanes]
    high = begin[lanes] + size[lanes]
    while len(lanes):
        go = (chain >= low) & ~placed[np.maximum(chain, 0)]
        s = chain[go]
        placed[s] = True
        spot = free[group[s]]
        order[spot] = s
        free[group[s]] += 1
        chain[go] = before[s]
        stop = ~go
        ends = stop & (turn >= high)
        read = stop & ~ends
        chain[read] = order[turn[read]] - 1
        turn[read] += 1
        if ends.any():
            keep = ~ends
            lanes, turn, chain, low, high = lanes[keep], turn[keep], chain[keep], low[keep], high[keep]
    return order


def suffix_arrays(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix arrays of consecutive texts, each in its own stretch of the result."""
    _, group, before = group_suffixes(text, begin, size)
    return order_groups(group, before, begin, size)


def _marks(bodies: list[np.ndarray], group: np.ndarray) -> list[np.ndarray]:
    """Per string, which of its windows have the same bytes as another start in the strings of its group."""
    marks = [np.zeros(max(0, len(b) - LENGTH + 1), bool) for b in bodies]
    n_groups = int(group.max()) + 1 if len(group) else 0
    weight = np.bincount(group, weights=[len(b) + 1 for b in bodies], minlength=n_groups)
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group, minlength=n_groups))[:-1])
    ranked = np.argsort(weight, kind="stable")  # texts of like length advance together
    for a in range(0, n_groups, TEXTS_AT_ONCE):
        chosen = [members[g] for g in ranked[a : a + TEXTS_AT_ONCE]]
        rows = np.concatenate(chosen)
        sizes = np.array([len(bodies[r]) for r in rows])
        place = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(int(sizes.sum()) + len(sizes), np.int16)  # zero ends each string
        text[_ranges(place, sizes)] = np.concatenate([bodies[r] for r in rows]).astype(np.int16) + 1
        per_text = np.array([len(c) for c in chosen])
        size = np.add.reduceat(sizes + 1, np.cumsum(per_text) - per_text)
        order = suffix_arrays(text, np.cumsum(size) - size, size)
        starts = np.zeros(len(text), bool)
        starts[_ranges(place, sizes - LENGTH + 1)] = True
        order = order[starts[order]]
        window = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(LENGTH, np.int16)), LENGTH)
        same = np.zeros(len(order) + 1, bool)  # windows of two texts never meet: their order is text by text
        lane = np.repeat(np.arange(len(size)), size)
        for b in range(1, len(order), 20_000):
            i = np.arange(b, min(b + 20_000, len(order)))
            i = i[lane[order[i]] == lane[order[i - 1]]]
            i = i[(text[order[i] + LENGTH - 1] == text[order[i - 1] + LENGTH - 1]) & (text[order[i] + LENGTH // 2] == text[order[i - 1] + LENGTH // 2])]
            same[i] = (window[order[i]] == window[order[i - 1]]).all(axis=1)
        again = np.zeros(len(text), bool)
        again[order] = same[:-1] | same[1:]
        for r, p in zip(rows, place):
            marks[r] = again[p : p + len(marks[r])]
    return marks


def _read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)


def _hashed(symbols: np.ndarray) -> np.ndarray:
    return BYTE_HASH[symbols]


BYTES = Symbols(LENGTH, GRAMS, CROWD, np.uint8, _read, _hashed, _marks)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, batch.schema.get_field_index("body")):
            out = []
            for row, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "body", "spans"))):
                raw = text.encode()
                gone = covered(spans, LENGTH, len(raw))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
                runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)) if spans else 0
                out.append((row, len(raw), int(gone.sum()), runs, kept))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes left) for every row.

    A byte goes if a string of ``LENGTH`` bytes covers it that starts anywhere else too, in any document.
    Null texts are empty; texts shorter than ``LENGTH`` stay whole. A repeated row is a document of its own,
    so it and its copy lose what they share. Null ids are kept, ties do not arise, an empty table gives an
    empty one. What is left of a text may not be valid UTF-8, hence bytes.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("body")).select(
        F.xxhash64("doc_id", "body").alias("key"), "doc_id", "body"
    )
    spans = repeated_windows(base, BYTES)
    return base.join(spans, "key", "left").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
