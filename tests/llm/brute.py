"""Plain-Python answers that the operators are held against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def roots(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def jaccard(docs):
    """{doc_id: (n_shingles, component_id, n_links)} of (doc_id, text) rows with distinct ids."""
    docs = sorted(docs)
    sets = [shingle_set(t) for _, t in docs]
    of = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            of[x].append(i)
    shared = defaultdict(int)
    for at in of.values():
        for a in range(len(at)):
            for b in range(a):
                shared[at[b], at[a]] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    n = [0] * len(docs)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {docs[i][0]: (len(sets[i]), docs[r][0], n[i]) for i, r in enumerate(roots(len(docs), links))}


def line_dedup(docs):
    """{doc_id: (n_lines, n_dropped, sha256)}."""
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(blank).translate(LOWER)
    holds = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holds[key(x)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holds.get(key(x), ())) < 2 or min(holds[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def encode(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def near_duplicates(rows, least=0.93):
    """{vec_id: (n_links, component_id)} of (vec_id, vector, label) rows with distinct ids."""
    rows = sorted(rows, key=lambda r: r[0])
    good = [i for i, (_, v, y) in enumerate(rows) if y is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for y in {rows[i][2] for i in good}:
        at = [i for i in good if rows[i][2] == y]
        x = np.array([rows[i][1] for i in at], dtype=np.float64)
        x /= np.sqrt((x**2).sum(1))[:, None]
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        links += [(at[i], at[j]) for i, j in zip(a, b, strict=True)]
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {rows[i][0]: (n[i], rows[r][0]) for i, r in enumerate(roots(len(rows), links))}


def nearest(rows, queries, k=20):
    """{query_id: [(vec_id, score)]} by inner product, ties to the smaller id."""
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    rows = [(i, v) for i, v in rows if ok(v)]
    x = np.array([v for _, v in rows], dtype=np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q, v in queries:
        if ok(v):
            s = np.zeros(len(x))
            for j, c in enumerate(v):  # equal rows, equal sums
                s += x[:, j] * float(c)
            order = np.lexsort((ids, -s))
            out[q] = [(int(ids[o]), float(s[o])) for o in order if ids[o] != q][:k]
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """{source: target} by pouring: a capped source gives its excess back, shared by weight among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= cap * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(cap * sizes[s] for s in over)
        open_ -= set(over)
    return target
