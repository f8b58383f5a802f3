"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def top_k(rows, k=10):
    """rows: (vec_id, ints)."""
    out = set()
    for q, v in rows:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if c != q)
            out |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])}
    return out


def lines(docs):
    first, holders = {}, defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            key = line.strip(BLANK).translate(LOWER)
            if len(key) >= 10:
                holders[key].add(d)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    out = []
    for d, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if first.get(x.strip(BLANK).translate(LOWER), d) == d]
        out.append((d, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def windows(docs, length, symbols):
    """Per document: its symbols, and which of them a repeated window covers."""
    seen = Counter()
    rows = [symbols(t or "") for _, t in docs]
    for s in rows:
        seen.update(tuple(s[i : i + length]) for i in range(len(s) - length + 1))
    out = []
    for s in rows:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((s, gone))
    return out


def byte_dedup(docs, length=200):
    out = []
    for (d, _), (s, gone) in zip(docs, windows(docs, length, lambda t: list(t.encode()))):
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(s), sum(gone), runs, sha(bytes(x for x, g in zip(s, gone) if not g))))
    return out


def word_dedup(docs, length=35):
    out = []
    for (d, _), (s, gone) in zip(docs, windows(docs, length, WORD.findall)):
        out.append((d, len(s), sum(gone), sha(" ".join(x for x, g in zip(s, gone) if not g))))
    return out


def fingerprint(text, shingle=3):
    w = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(docs, max_bits=2):
    prints = [fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(len(docs)):
                if group[j] < group[i] and (prints[i] ^ prints[j]).bit_count() <= max_bits:
                    group[i], changed = group[j], True
    low = {}
    for (d, _), g in zip(docs, group):
        low[g] = min(low.get(g, d), d)
    return [(d, f"{p:016x}", low[g]) for (d, _), p, g in zip(docs, prints, group)]


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    own = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(covered)
