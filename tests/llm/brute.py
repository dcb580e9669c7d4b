"""Plain single-machine versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np


class Classes:
    """Union-find over keys, the smallest key as root."""

    def __init__(self, keys):
        self.parent = {k: k for k in keys}

    def find(self, k):
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def similar_sets(docs, n=4, percent=85):
    """docs: {id: text} -> {id: (size, component)}, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in docs.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    classes, by_set = Classes(docs), defaultdict(list)
    for i, s in sets.items():
        if s:
            by_set[s].append(i)
    for group in by_set.values():
        for i in group[1:]:
            classes.join(group[0], i)
    done = set()
    for i, s in sets.items():
        overlap = defaultdict(int)
        for g in s:
            for j in holders[g]:
                if j < i:
                    overlap[j] += 1
        for j, o in overlap.items():
            if (j, i) not in done and 100 * o >= percent * (len(s) + len(sets[j]) - o):
                classes.join(i, j)
    return {i: (len(s), classes.find(i)) for i, s in sets.items()}


def repeats(texts, length, least_words=0):
    """Kept bytes and number of removed bytes and spans of each text; runs of fewer words stay."""
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(list)
    for i, t in enumerate(raw):
        for p in range(len(t) - length + 1):
            seen[hashlib.blake2b(t[p : p + length], digest_size=12).digest()].append((i, p))
    covered = [np.zeros(len(t), bool) for t in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                covered[i][p : p + length] = True
    out = []
    for t, c in zip(raw, covered):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(int), [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            c[a:b] = len(t[a:b].split()) >= least_words
        kept = bytes(b for b, gone in zip(t, c) if not gone)
        spans = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        out.append((len(t), int(c.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def near_vectors(rows, threshold=0.93):
    """rows: [(id, vector, label)] -> {id: (links, component)}"""
    classes, links = Classes([r[0] for r in rows]), defaultdict(int)
    good = [(i, np.array(v, float), label) for i, v, label in rows if usable(v) and label is not None]
    for x in range(len(good)):
        for y in range(x):
            (i, a, la), (j, b, lb) = good[x], good[y]
            if la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                classes.join(i, j)
    return {i: (links[i], classes.find(i)) for i, _, _ in rows}


def nearest(base, queries, k):
    """{query: [(id, score)]} by comparing each query with every row."""
    good = [(i, np.array(v, float)) for i, v in base if usable(v)]
    out = {}
    for q, v in queries:
        if usable(v):
            scored = [(float(x @ np.array(v, float)), i) for i, x in good if i != q and len(x) == len(v)]
            out[q] = [(i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def licenses(text, phrases=(("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))):
    """Words, places of phrases and their labels."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))
    places, labels = [], set()
    for phrase, label in phrases:
        own = phrase.split()
        at = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
