"""Plain single-process versions of the corpus operators, to hold their results against."""

import hashlib
from collections import defaultdict

import numpy as np


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def substring(docs, span=13):
    """{doc_id: (n_words, n_removed, sha256)} of [(doc_id, text)]."""
    words = {i: (t or "").encode().split() for i, t in docs}
    first = {}
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - span + 1):
            first.setdefault(tuple(w[k : k + span]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - span + 1):
            if first[tuple(w[k : k + span])] < i:
                gone.update(range(k, k + span))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def simhash(docs, most=4):
    """{doc_id: (fingerprint, component)}, the fingerprints bit by bit and all pairs compared."""
    import xxhash

    fps = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    ids = sorted(fps)
    x = np.array([fps[i] for i in ids], np.uint64)
    links = []
    for k in range(len(ids)):
        links += [(ids[k], ids[k + 1 + j]) for j in np.flatnonzero(np.bitwise_count(x[k + 1 :] ^ x[k]) <= most)]
    comp = components(ids, links)
    return {i: (f"{fps[i]:016x}", comp[i]) for i in ids}


def vectors(rows, threshold=0.95):
    """{id: (n_links, component)} of [(id, vector)]; vectors that can't be compared are None."""
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids, links, n = sorted(good), [], defaultdict(int)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= threshold:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    comp = components(ids, links)
    return {i: (n[i], comp.get(i, i)) for i, _ in rows}
