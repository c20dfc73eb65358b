"""The operators once more, one text at a time, from their definitions."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

BLANK = b" \t\r\x0b\x0c"


def sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes: A-Z only


def exact(rows):
    """{(doc_id, sha): (keep_id, group_size)} and how many rows stay per group."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[sha(lowered(text))].append(doc_id)
    out = {}
    for key, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            out[i, key] = (max(known) if known else None, len(ids))
    return out, groups


def without_windows(rows, window):
    """[(doc_id, n_words, n_removed, kept text)] in the order of the rows."""
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                keep[k : k + window] = [False] * window
        out.append((i, len(w), keep.count(False), b" ".join(x for x, y in zip(w, keep) if y).decode()))
    return out


def without_lines(rows, shortest):
    """{doc_id: (n_lines, n_removed, kept text)}; ids are distinct."""
    docs = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = (t or "").encode().split(b"\n")
        docs.append((i, lines, [k for k, x in enumerate(lines) if x.strip(BLANK)]))
    first = {}
    for i, lines, at in docs:
        for k in range(len(at) - shortest + 1):
            first.setdefault(tuple(lines[j].strip(BLANK) for j in at[k : k + shortest]), (i, k))
    out = {}
    for i, lines, at in docs:
        gone = set()
        for k in range(len(at) - shortest + 1):
            if first[tuple(lines[j].strip(BLANK) for j in at[k : k + shortest])] != (i, k):
                gone |= set(at[k : k + shortest])
        out[i] = (len(at), len(gone), b"\n".join(x for j, x in enumerate(lines) if j not in gone).decode())
    return out


def simhash(text: str | None, words: int = 3) -> int:
    w = lowered(text).split()
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, distance: int = 3):
    """{value: smallest value that links reach}."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    array = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= distance):
            a, b = sorted((find(v), find(values[i + 1 + j])))
            root[b] = a
    return {v: find(v) for v in values}


def classes(rows, words: int = 3):
    """{doc_id: (fingerprint, component_id)}; ids are distinct or null."""
    prints = [(i, simhash(t, words)) for i, t in rows]
    root = linked(f for _, f in prints)
    smallest = {}
    for i, f in prints:
        if i is not None:
            smallest[root[f]] = min(i, smallest.get(root[f], i))
    return {i: (f"{f:016x}", smallest.get(root[f])) for i, f in prints}
