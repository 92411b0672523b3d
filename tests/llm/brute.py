"""Plain readings of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def repeats(docs, window=35):
    """[(id, text)] -> [(id, n_words, n_removed, kept_sha256)], in order."""
    toks = [words(t) for _, t in docs]
    seen = Counter(tuple(w[i:i + window]) for w in toks for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, toks):
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s:s + window])] > 1:
                gone.update(range(s, s + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), sha(" ".join(kept))))
    return out


def shingle_set(text, size=3):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def components(docs, size=3, num=90, den=100):
    """[(id, text)] -> {id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = [(i, shingle_set(t, size)) for i, t in docs]
    by = defaultdict(list)
    for j, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(j)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for j, (_, s) in enumerate(sets):
        shared = Counter(k for x in s for k in by[x] if k < j)
        for k, both in shared.items():
            if den * both >= num * (len(s) + len(sets[k][1]) - both):
                parent[find(j)] = find(k)
    low = {}
    for j, (i, _) in enumerate(sets):
        r = find(j)
        low[r] = min(low.get(r, i), i)
    return {i: (len(s), low[find(j)]) for j, (i, s) in enumerate(sets)}


def quality_scores(docs, labels, statistics, shrink, temperature):
    """[(id, text)], [(id, 0 or 1)] -> {id: score} of two shrunken Gaussians, by plain inverses and determinants."""
    texts = dict(docs)
    marks = defaultdict(set)
    for i, y in labels:
        marks[i].add(y)
    xs = [np.array([statistics((texts[i] or "").encode()) for i, y in marks.items() if y == {c} and i in texts and zlib.crc32(str(i).encode()) % 3 != 1]) for c in (0, 1)]
    n = np.array([len(x) for x in xs])
    pooled = sum(k * np.cov(x.T, bias=True) for k, x in zip(n, xs)) / n.sum()
    scale = np.sqrt(np.diag(pooled))
    wide = np.outer(scale, scale)
    target = (1 - shrink) * pooled / wide + shrink * np.eye(len(scale))
    covs = [(1 - shrink) * np.cov(x.T, bias=True) / wide + shrink * target + 1e-6 * np.eye(len(scale)) for x in xs]

    def density(z, c):
        away = z - xs[c].mean(axis=0) / scale
        return math.log(n[c] / n.sum()) - 0.5 * away @ np.linalg.inv(covs[c]) @ away - 0.5 * np.linalg.slogdet(covs[c])[1]

    out = {}
    for i, t in docs:
        z = np.array(statistics((t or "").encode())) / scale
        out[i] = 1 / (1 + math.exp(-max(-50, min(50, (density(z, 1) - density(z, 0)) / temperature))))
    return out


def without_boilerplate(docs, ratio, min_pages):
    """[(id, host, text)] -> [(id, text)]"""
    pages, counts = Counter(h for _, h, _ in docs), Counter()
    strip = lambda x: x.strip(" \t\r\v\f")
    for _, h, t in docs:
        counts.update({(h, strip(x)) for x in (t or "").split("\n")} if t is not None else ())
    gone = {k for k, n in counts.items() if k[1] and n >= min_pages and n > ratio * pages[k[0]]}
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if (h, strip(x)) not in gone)) for i, h, t in docs]


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contaminated(texts, items, window=10):
    """Which of ``texts`` hold a window of an item."""
    wins = defaultdict(set)
    for t in items:
        w = plain_words(t)
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            wins[k].add(tuple(w[s:s + k]))
    return [any(tuple(w[s:s + k]) in known for k, known in wins.items() for s in range(len(w) - k + 1)) for w in map(plain_words, texts)]


def mixed(docs):
    """[(id, source, text)] -> {id: (size, source_size, target, taken)}, by sorted hashes."""
    size = {i: len(words(t)) for i, _, t in docs}
    by = defaultdict(list)
    for i, s, _ in docs:
        by[s].append(i)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[j % 3] for j, s in enumerate(names)}
    total = {s: sum(size[i] for i in by[s]) for s in names}
    target, free, budget = {}, set(names), 1.5 * sum(total.values())
    while free:
        level = budget / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * total[s]]
        for s in over:
            target[s] = 2.0 * total[s]
            budget -= target[s]
        free -= set(over)
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
    out = {}
    for s in names:
        whole = int(target[s] >= total[s])
        left = target[s] - whole * total[s]
        for i in sorted(by[s], key=lambda i: sha(str(i))):
            more = left > 0 and size[i] - left < left
            out[i] = (size[i], total[s], target[s], size[i] * (whole + (size[i] <= left or more)))
            left -= size[i] if size[i] <= left else math.inf
    return out
