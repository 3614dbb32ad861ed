"""Slow, plain versions to test against."""

import hashlib
import re


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def shingles(text, n):
    w = [lower(x) for x in words(text)]
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return {x: root(x) for x in nodes}


def jaccard_join(rows, n, percent):
    """rows: (doc_id, text). doc_id -> (set size, component, links)."""
    sets = {d: shingles(t, n) for d, t in rows}
    full = [d for d in sets if sets[d]]
    where = {}
    for d in full:
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    pairs = set()
    for d in full:
        count = {}
        for s in sets[d]:
            for x in where[s]:
                if x > d:
                    count[x] = count.get(x, 0) + 1
        pairs |= {(d, x) for x, c in count.items() if 100 * c >= percent * (len(sets[d]) + len(sets[x]) - c)}
    comp = components(list(sets), pairs)
    links = {d: 0 for d in sets}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return {d: (len(sets[d]), comp[d], links[d]) for d in sets}


def cut(rows, k):
    """rows: (doc_id, text). doc_id -> (n_bytes, n_removed, n_spans, kept bytes)."""
    texts = {d: (t or "").encode() for d, t in rows}
    least = {}
    for d in sorted(texts, reverse=True):
        b = texts[d]
        for i in range(len(b) - k + 1):
            least[b[i : i + k]] = d
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if least[b[i : i + k]] < d:
                gone[i : i + k] = b"\x01" * k
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), spans, kept)
    return out


def sha256(b):
    return hashlib.sha256(b).hexdigest()
