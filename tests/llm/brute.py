"""Plain Python versions of the operators, for small tables."""

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def jaccard(docs, k=5, percent=75):
    """{id: (size, component)} for [(id, text)]."""
    sets = {}
    for i, t in docs:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    both[j] += 1
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substring(docs, window=50):
    """{id: (n_words, n_removed, sha256)} for [(id, text)]."""
    import hashlib

    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out
