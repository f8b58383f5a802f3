"""Reproducible pseudo-random draws.

A draw depends only on the seed and the row's own key, never on partitioning or
task order, so a recomputed task draws the same values again.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 1 << 32


def draw(seed: int | str, *keys: Column) -> Column:
    """Integer in ``[0, 2**32)`` from the first 8 hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str, *keys: Column) -> Column:
    return draw(seed, *keys) / F.lit(float(DRAW_RANGE))


def draw_bucket(value: Column, buckets: int) -> Column:
    """Equal slices of the draw range: increasing in the draw and evenly filled."""
    return F.shiftright(value * F.lit(buckets), 32)


# --- the same draws for many numbers at once ------------------------------------

BLOCK = 8_192  # messages hashed at a time, so that all work arrays stay in cache
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def draws_upto(last: int, *keys) -> np.ndarray:
    """``draw(*keys, n)`` for each ``n`` from 1 to ``last``, as unsigned 32-bit numbers; the seed is the first key."""
    prefix = ":".join([*map(str, keys), ""]).encode()
    return np.concatenate([
        _md5_heads(prefix, text[lo : lo + BLOCK]) for text in _decimals(last) for lo in range(0, len(text), BLOCK)
    ] or [np.zeros(0, np.uint32)])


@lru_cache(4)
def _decimals(last: int) -> list[np.ndarray]:
    """The numbers from 1 to ``last`` as ASCII digits, one array for each length."""
    out, low = [], 1
    while low <= last:
        numbers = np.arange(low, min(10 * low - 1, last) + 1)
        powers = 10 ** np.arange(len(str(low)) - 1, -1, -1)
        out.append((numbers[:, None] // powers % 10 + 48).astype(np.uint8))
        low *= 10
    return out


def _md5_heads(prefix: bytes, text: np.ndarray) -> np.ndarray:
    """First 32 bits of the MD5 of ``prefix`` and each row of ``text``, all of one length."""
    n, width = text.shape
    length = len(prefix) + width
    if length > 55:  # more than one block of MD5
        return np.array([int.from_bytes(hashlib.md5(prefix + t.tobytes()).digest()[:4], "big") for t in text], np.uint32)
    fixed = bytearray(prefix + bytes(width) + b"\x80" + bytes(55 - length) + (8 * length).to_bytes(8, "little"))
    low, high = len(prefix) // 4, (length - 1) // 4
    words: list = [int.from_bytes(fixed[4 * i : 4 * i + 4], "little") for i in range(16)]
    moving = np.tile(np.frombuffer(bytes(fixed[4 * low : 4 * high + 4]), np.uint8), (n, 1))
    moving[:, len(prefix) - 4 * low : length - 4 * low] = text
    for i, column in enumerate(moving.view("<u4").T):
        words[low + i] = np.ascontiguousarray(column)
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        word = words[_WORD[i]]
        if isinstance(word, int):
            t += np.uint32((word + _ADDED[i]) & 0xFFFFFFFF)
        else:
            t += word
            t += np.uint32(_ADDED[i])
        np.left_shift(t, np.uint32(_SHIFTS[i]), out=u)
        t >>= np.uint32(32 - _SHIFTS[i])
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    a += np.uint32(_START[0])
    return a.byteswap()
