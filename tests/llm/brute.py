"""Plain Python versions that the operators are held against."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def near_duplicate_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, least doc_id reachable), by an index from shingle to documents."""
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for d in sorted(sets):
        shared: dict[int, int] = defaultdict(int)
        for s in sets[d]:
            for e in index[s]:
                shared[e] += 1
            index[s].append(d)
        for e, both in shared.items():
            if 100 * both >= 75 * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def without_repeats(rows: list[tuple[int, str | None]], k: int = 50) -> dict[int, tuple[int, int, int, bytes]]:
    """doc_id -> (bytes, removed, spans, kept bytes): k-byte strings of documents with smaller ids go."""
    first: dict[bytes, int] = {}
    data = {d: (t or "").encode() for d, t in rows}
    for d in sorted(data):
        for i in range(len(data[d]) - k + 1):
            first.setdefault(data[d][i:i + k], d)
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if first[b[i:i + k]] < d:
                gone[i:i + k] = b"\x01" * k
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out
