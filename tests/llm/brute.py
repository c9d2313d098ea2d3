"""Brute-force versions of the corpus operators, for small tables."""

import hashlib
from collections import defaultdict


def repeated_bytes(texts, window=200):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in data:
        for p in range(len(b) - window + 1):
            seen[b[p : p + window]] += 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(ids, linked):
    """The least id reachable from each position; linked: pairs of positions."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def near_duplicates(rows, percent):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows."""
    sets = [shingle_set(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    common = defaultdict(int)
    for members in by.values():
        for a in range(len(members)):
            for b in range(a):
                common[members[b], members[a]] += 1
    linked = [(a, b) for (a, b), k in common.items() if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k)]
    found = components([i for i, _ in rows], linked)
    return [(i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, found)]


def linked_vectors(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector, label) rows."""
    import math

    import numpy as np

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, float) / np.linalg.norm(np.array(v, float))

    units = [unit(v) if label is not None else None for _, v, label in rows]
    pairs, n = [], [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= threshold:
                pairs.append((a, b))
                n[a] += 1
                n[b] += 1
    found = components([r[0] for r in rows], pairs)
    return [(r[0], k, c, r[0] == c) for r, k, c in zip(rows, n, found)]
