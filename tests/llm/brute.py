"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def jaccard_components(rows, k, percent):
    """rows: (id, text) with different ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                links.append((a, b))
    return {i: len(s) for i, s in sets.items()}, components(ids, links)


def repeated(texts, size):
    """Per text: (removed bytes, spans, sha256 of the rest, the rest)."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                covered[i : i + size] = b"\1" * size
        rest = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1]))
        out.append((sum(covered), spans, hashlib.sha256(rest).hexdigest(), rest))
    return out


def jump(key, buckets):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b
