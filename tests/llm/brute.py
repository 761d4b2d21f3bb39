"""Plain single-process versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall(text or "")


class Union:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def near_copies(docs, size, percent):
    """{id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {}
    for i, text in docs:
        w = words((text or "").translate(A_TO_Z))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    union, holders = Union(sets), defaultdict(list)
    for i, own in sets.items():
        common = defaultdict(int)
        for s in own:
            for j in holders[s]:
                common[j] += 1
            holders[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                union.join(i, j)
    return {i: (len(own), union.find(i)) for i, own in sets.items()}


def without_repeats(docs, window):
    """{id: (words, removed, sha256 of the kept words)}; docs in order of their ids."""
    first, found = {}, {}
    for i, text in docs:
        w = words(text)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    for i, text in docs:
        w = words(text)
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i, k):
                keep[k : k + window] = [False] * window
        kept = " ".join(x for x, good in zip(w, keep) if good)
        found[i] = (len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())
    return found


def close_vectors(rows, cosine):
    """{id: (links, component)} of rows (id, label, vector)."""

    def sound(label, v):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    union, links = Union([i for i, _, _ in rows]), defaultdict(int)
    good = [(i, label, v) for i, label, v in rows if sound(label, v)]
    for n, (i, label, v) in enumerate(good):
        for j, other, u in good[:n]:
            if label == other and len(u) == len(v):
                dot = sum(a * b for a, b in zip(u, v))
                if u == v or dot / math.sqrt(sum(a * a for a in u) * sum(b * b for b in v)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    union.join(i, j)
    return {i: (links[i], union.find(i)) for i, _, _ in rows}


def targets(sizes, weights, most):
    """Targets by resharing what is above the caps again and again."""
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        weight = sum(w for s, w in weights.items() if s not in capped)
        share = {s: most * sizes[s] if s in capped else rest * weights[s] / weight for s in sizes}
        above = {s for s in sizes if s not in capped and share[s] > most * sizes[s]}
        if not above:
            return share
        capped |= above


def highest_quotients(votes, seats):
    held = dict.fromkeys(votes, 0)
    if sum(votes.values()):
        for _ in range(seats):
            best = max(sorted(votes), key=lambda u: votes[u] / (2 * held[u] + 1))
            held[best] += 1
    return held
