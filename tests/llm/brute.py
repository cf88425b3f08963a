"""Plain Python versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def words(s):
    return WORD.findall(s or "")


def substring_dedup(docs, size):
    """docs: [(id, text)] -> [(id, words, removed, kept)]"""
    key = lambda i: float("inf") if i is None else i
    owner = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            owner[g] = min(owner.get(g, float("inf")), key(i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if owner[tuple(w[k : k + size])] < key(i):
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingle_set(text, size):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def near_duplicates(docs, size, percent):
    """docs: [(id, text)], ids distinct -> {id: (set size, component, kept)}"""
    sets = {i: shingle_set(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    common = Counter()
    for g, ids in where.items():
        for a in range(len(ids)):
            for b in range(a):
                common[tuple(sorted((ids[a], ids[b])))] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
