"""SentencePiece-style BPE encoding with seeded merge-dropout, and lossless decoding.

The vocabulary comes from a model file; it is read once and broadcast. Texts are cut before each run of
spaces, because no piece has a space after another character, and every cut is encoded on its own.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.batches import pieces as slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # how the model file writes a space
CUT = re.compile(r" *[^ ]+| +")
MATRIX_CHARS = 64  # longer cuts go through the agenda one by one
# Arrays over every merge of every cut live at once for one slice; measured, 1 MB of text takes about 85 MB in
# a worker and 4 MB about 290, while smaller slices encode the same cuts more often.
SLICE_BYTES = 1 << 20
NO_MERGE = np.int32(2**31 - 1)
TABLE_BITS = 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _skipped(key: np.ndarray, at: np.ndarray, piece: np.ndarray, dropout: float) -> np.ndarray:
    """Whether a merge into ``piece`` is skipped: by a hash of the occurrence's key, the place of the left part and the piece."""
    mix = _mixed(key.astype(np.uint64) + at.astype(np.uint64) * np.uint64(0x9E3779B1) + (piece + 1).astype(np.uint64) * np.uint64(0x85EBCA77C2B2AE63))
    return mix < np.uint64(min(dropout, 1.0) * (2**64 - 2049))


@dataclass
class Vocabulary:
    """Pieces of a model: characters, merges by (left, right), their order, and bytes of each id."""

    size: int
    of_char: np.ndarray  # code point to id; size + code point where the model has no piece
    byte_ids: np.ndarray
    order: np.ndarray  # id to rank, the best merge first
    by_rank: np.ndarray
    slots: np.ndarray  # open-addressed keys left * 2**32 + right
    merged: np.ndarray
    data: np.ndarray  # bytes of all ids, one after the other
    starts: np.ndarray

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        of_char = np.arange(n, n + 0x110000, dtype=np.int64)
        byte_ids, text, raw = np.full(256, -1, np.int64), {}, []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                plain = piece.replace(MARK, " ")
                if " " in plain.lstrip(" "):
                    raise ValueError("a piece with a space inside needs another cut of texts")
                text[plain] = i
                raw.append(plain.encode())
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte fallback, so decoding could lose characters")
        for plain, i in text.items():
            if len(plain) == 1:
                of_char[ord(plain)] = i
        scores = np.array([model.get_score(i) for i in range(n)])
        by_rank = np.lexsort((np.arange(n), -scores)).astype(np.int32)
        order = np.empty(n, np.int32)
        order[by_rank] = np.arange(n, dtype=np.int32)
        pairs = {}
        for plain, i in text.items():
            for at in range(1, len(plain)):
                left, right = text.get(plain[:at]), text.get(plain[at:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        slots, merged = np.full(1 << TABLE_BITS, -1, np.int64), np.full(1 << TABLE_BITS, -1, np.int64)
        keys = np.array(list(pairs), np.int64)
        for key, at in zip(keys.tolist(), Vocabulary._slot(keys).tolist()):
            while slots[at] != -1:
                at = (at + 1) % (1 << TABLE_BITS)
            slots[at], merged[at] = key, pairs[key]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        return Vocabulary(n, of_char, byte_ids, order, by_rank, slots, merged, np.frombuffer(b"".join(raw), np.uint8), starts)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def candidates(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, key: np.ndarray, dropout: float) -> np.ndarray:
        """Rank of the piece that each pair would make; NO_MERGE where there is none or its hash skips it.

        The hash is keyed by the occurrence's key, the place of the left part and the piece.
        """
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        found = np.full(keys.shape, -1, np.int64)
        open_ = np.arange(keys.size).reshape(keys.shape)[(left < self.size) & (right < self.size)]
        while open_.size:
            s = slot.ravel()[open_]
            have = self.slots[s]
            hit = have == keys.ravel()[open_]
            found.ravel()[open_[hit]] = self.merged[s[hit]]
            open_ = open_[~hit & (have != -1)]
            slot.ravel()[open_] = (slot.ravel()[open_] + 1) % len(self.slots)
        ranks = np.where(found >= 0, self.order[found], NO_MERGE)
        return np.where(_skipped(key, at, found, dropout), NO_MERGE, ranks) if dropout > 0 else ranks

    def encode_equal(self, symbols: np.ndarray, keys: np.ndarray, dropout: float, taken: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, ids) for cuts of one length, given as a matrix of symbols.

        All cuts take their next merge from the agenda together: the best candidate, the leftmost of equals.
        ``taken`` gets rows, places and pieces of the merges.
        """
        done, rows = [], np.arange(len(symbols))
        at = np.broadcast_to(np.arange(symbols.shape[1], dtype=np.int64), symbols.shape).copy()
        agenda = self.candidates(symbols[:, :-1], symbols[:, 1:], at[:, :-1], keys[:, None], dropout)
        while symbols.shape[1] > 1 and len(rows):
            best = agenda.argmin(axis=1)
            rank = agenda[np.arange(len(rows)), best]
            live = rank != NO_MERGE
            if not live.all():
                done.append((rows[~live], symbols[~live]))
                rows, symbols, at, agenda, keys, best, rank = (x[live] for x in (rows, symbols, at, agenda, keys, best, rank))
                if not len(rows):
                    return done
            line = np.arange(len(rows))
            if taken is not None:
                taken.append((rows, at[line, best], self.by_rank[rank]))
            before = np.arange(symbols.shape[1] - 1) <= best[:, None]
            symbols = np.where(before, symbols[:, :-1], symbols[:, 1:])
            at = np.where(before, at[:, :-1], at[:, 1:])
            symbols[line, best] = self.by_rank[rank]
            agenda = np.where(np.arange(symbols.shape[1] - 1) < best[:, None], agenda[:, :-1], agenda[:, 1:])
            for col, ok in ((best - 1, best > 0), (best, best < symbols.shape[1] - 1)):
                r, c = line[ok], col[ok]
                agenda[r, c] = self.candidates(symbols[r, c], symbols[r, c + 1], at[r, c], keys[r], dropout)
        if len(rows):
            done.append((rows, symbols))
        return done

    def encode_long(self, symbols: np.ndarray, key: np.ndarray, dropout: float) -> np.ndarray:
        """The same for one long cut, with a heap for the agenda."""
        n = len(symbols)
        sym, nxt, prv, alive = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        all_at = np.arange(n - 1, dtype=np.int64)
        ranks = self.candidates(symbols[:-1], symbols[1:], all_at, np.broadcast_to(key, n - 1), dropout).tolist()
        heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(ranks) if r != NO_MERGE]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or sym[i] != left or sym[j] != right:
                continue
            sym[i], alive[j], nxt[i] = int(self.by_rank[rank]), False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for a in (prv[i], i):
                if a >= 0 and nxt[a] < n:
                    b = nxt[a]
                    r = int(self.candidates(np.array([sym[a]]), np.array([sym[b]]), np.array([a]), key.reshape(1), dropout)[0])
                    if r != NO_MERGE:
                        heapq.heappush(heap, (r, a, sym[a], sym[b]))
        return np.array([s for s, ok in zip(sym, alive) if ok], np.int64)

    def encode_cuts(self, cuts: list[str], keys: np.ndarray, dropout: float, taken: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all cuts one after the other, and how many each has. ``taken`` gets the merges of cuts up to MATRIX_CHARS."""
        sizes = np.array([len(c) for c in cuts], np.int64)
        symbols = self.of_char[np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = np.cumsum(sizes) - sizes
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            if size == 1:
                parts.append((rows, symbols[begin[rows]][:, None]))
            elif size <= MATRIX_CHARS:
                block = symbols[begin[rows][:, None] + np.arange(size)]
                own: list | None = None if taken is None else []
                parts += [(rows[r], ids) for r, ids in self.encode_equal(block, keys[rows], dropout, own)]
                if own:
                    taken += [(rows[r], at, piece) for r, at, piece in own]
            else:
                for r in rows:
                    ids = self.encode_long(symbols[begin[r] : begin[r] + size], keys[r : r + 1], dropout)
                    parts.append((np.array([r]), ids[None, :]))
        counts = np.zeros(len(cuts), np.int64)
        for rows, ids in parts:
            counts[rows] = ids.shape[1]
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for rows, ids in parts:
            out[first[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, counts

    def with_bytes(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece are replaced by the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, counts
        found, which = np.unique(symbols[odd], return_inverse=True)
        spelled = [self.byte_ids[np.frombuffer(chr(int(c) - self.size).encode(), np.uint8)] for c in found]
        lengths = np.array([len(s) for s in spelled])
        width = np.ones(len(symbols), np.int64)
        width[odd] = lengths[which]
        place = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        plain = symbols < self.size
        out[place[plain]] = symbols[plain]
        for i, s in enumerate(spelled):
            spots = place[odd[which == i]]
            out[spots[:, None] + np.arange(len(s))] = s
        owner = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(owner, weights=width, minlength=len(counts)).astype(np.int64)

    def encode_texts(self, texts: list[str | None], keys: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has. Empty texts have none."""
        known: dict[str, int] = {}
        codes: list[int] = []
        per_text = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = CUT.findall(" " + text)
                per_text[i] = len(found)
                codes.extend([known.setdefault(c, len(known)) for c in found])
        if not codes:
            return np.zeros(0, np.int64), per_text
        place = np.arange(len(codes)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        names, which = list(known), np.array(codes, np.int64)
        if dropout > 0:
            own = _mixed(np.repeat(keys.astype(np.uint64), per_text) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            own = _mixed(own + np.uint64(seed * 1_000_003 % 2**64))
            ids, counts, which = self._dropped(names, which, own, dropout)
        else:
            ids, counts = self.with_bytes(*self.encode_cuts(names, np.zeros(len(names), np.uint64), 0.0))
        out = _gather(ids, np.cumsum(counts) - counts, counts, which)
        owner = np.repeat(np.arange(len(texts)), per_text)
        return out, np.bincount(owner, weights=counts[which], minlength=len(texts)).astype(np.int64)

    def _dropped(self, names: list[str], codes: np.ndarray, own: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of entries one after the other, how many each has, and the entry of each occurrence of ``names[code]``.

        Every occurrence draws by its own key. One that skips none of the merges its cut takes without
        dropout ends like that one, which is encoded once; skipped others were never taken. The rest, and
        cuts of more than MATRIX_CHARS, are encoded one by one.
        """
        long = np.array([len(c) > MATRIX_CHARS for c in names])
        short = np.flatnonzero(~long)
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ids, counts = self.encode_cuts([names[c] for c in short], np.zeros(len(short), np.uint64), 0.0, taken)
        entry = np.full(len(names), -1, np.int64)
        entry[short] = np.arange(len(short))
        changed = long[codes]
        if taken:
            cut, at, piece = (np.concatenate(x) for x in zip(*taken))
            order = np.argsort(cut, kind="stable")
            at, piece = at[order], piece[order]
            merges = np.zeros(len(names), np.int64)
            merges[short] = np.bincount(cut, minlength=len(short))
            first = np.zeros(len(names), np.int64)
            first[short] = np.cumsum(merges[short]) - merges[short]
            n = merges[codes]
            spot = np.repeat(first[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            skip = _skipped(np.repeat(own, n), at[spot], piece[spot].astype(np.int64), dropout)
            changed |= np.bincount(np.repeat(np.arange(len(codes)), n)[skip], minlength=len(codes)) > 0
        rest = np.flatnonzero(changed)
        which = entry[codes]
        which[rest] = len(short) + np.arange(len(rest))
        if len(rest):
            more, sizes = self.encode_cuts([names[c] for c in codes[rest]], own[rest], dropout)
            ids, counts = np.concatenate([ids, more]), np.concatenate([counts, sizes])
        return *self.with_bytes(ids, counts), which

    def decode_ids(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, without the space put before each, and how many bytes each has."""
        sizes = np.diff(self.starts)
        data = _gather(self.data, self.starts[:-1], sizes, ids)
        owner = np.repeat(np.arange(len(counts)), counts)
        lengths = np.bincount(owner, weights=sizes[ids], minlength=len(counts)).astype(np.int64)
        keep = np.ones(len(data), bool)
        keep[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        return data[keep], np.maximum(lengths - 1, 0)


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches ``which`` of ``data``, one after the other."""
    n = sizes[which]
    shift = starts[which] - (np.cumsum(n) - n)
    return data[np.repeat(shift, n) + np.arange(int(n.sum()))]


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def encode(
    docs: DataFrame, dropout: float = 0.1, seed: int = 0, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``ids``, ``n_pieces``, and ``lossless``: whether decoding the ids gave the text again.

    ``dropout`` is the share of candidate merges that their hash, keyed by ``seed``, id, place and piece, skips;
    0 gives the model's own segmentation. Results depend on nothing else, so a task that runs again repeats
    them. Null and empty texts have no ids. A null id is keyed as zero, repeated rows are encoded alike, very
    long texts and texts without spaces are encoded whole. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                texts = part.column(1).to_pylist()
                keys = _mixed(np.array([k or 0 for k in part.column(0).to_pylist()], np.int64).astype(np.uint64))
                ids, counts = vocabulary.encode_texts(texts, keys, dropout, seed)
                data, lengths = vocabulary.decode_ids(ids, counts)
                ends = np.cumsum(lengths)
                raw = data.tobytes()
                same = [(t or "").encode() == raw[e - n : e] for t, n, e in zip(texts, lengths.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(_offsets(counts), pa.array(ids.astype(np.int32))), pa.array(counts), pa.array(same)],
                    ["doc_id", "ids", "n_pieces", "lossless"],
                )

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            counts = np.diff(np.asarray(lists.offsets, dtype=np.int64))
            data, lengths = shared.value.decode_ids(np.asarray(lists.flatten(), dtype=np.int64), counts)
            texts = pa.StringArray.from_buffers(len(batch), _offsets(lengths).buffers()[1], pa.py_buffer(data.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
