"""Plain-Python versions of what the operators compute."""

import re
from collections import Counter, defaultdict


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def shingles(text, size):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def near_duplicates(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    u = Union()
    ids = sorted(sets)
    for i in ids:
        u.find(i)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u.join(a, b)
    return {i: (len(sets[i]), u.find(i), u.find(i) == i) for i in ids}


def repeats(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = defaultdict(list)
    for i, b in texts:
        covered = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                covered[k : k + length] = [True] * length
        spans = sum(c and not p for c, p in zip(covered, [False, *covered], strict=False))
        out[i].append((len(b), sum(covered), spans, bytes(x for x, c in zip(b, covered, strict=True) if not c)))
    return out
