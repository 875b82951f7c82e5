"""Slow, plain versions of the operators."""

from __future__ import annotations

import hashlib


def groups(ids: list, linked) -> dict:
    """Smallest reachable id of each id."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def shingles(text: str | None) -> set[bytes]:
    """The set of a text's five-word shingles; all its words if there are fewer."""
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def simhash(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def repeats(rows: list[tuple]) -> list[tuple]:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 by comparing every 50-byte string."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49 if i is not None else 0):
            w = raw[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 49 if i is not None else 0):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and not b for g, b in zip(gone, [False, *gone]))
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)
