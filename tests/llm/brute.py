"""The same results the plain way: Python loops over small tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

GRAPHIC = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower(text: str | None) -> str:
    return (text or "").translate(LOWER)


def shingle_set(text: str | None) -> set:
    w = GRAPHIC.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def near_duplicates(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component)."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contamination(text: str | None, items: list[tuple[str, str | None]], window: int = 10) -> tuple[int, set[int], set[str]]:
    """Number of words, hit words, items hit."""
    w = ALNUM.findall(lower(text))
    windows = defaultdict(set)
    for i, t in items:
        v = ALNUM.findall(lower(t))
        for k in range(max(len(v) - window, 0) + 1 if v else 0):
            windows[tuple(v[k : k + window])].add(i)
    hit, found = set(), set()
    for size in {len(x) for x in windows}:
        for k in range(len(w) - size + 1):
            own = windows.get(tuple(w[k : k + size]))
            if own:
                hit |= set(range(k, k + size))
                found |= own
    return len(w), hit, found


class Katz:
    """Bigram model with dictionaries."""

    def __init__(self, texts: list[str | None], discounts, cut: int):
        self.cut, self.c1, self.c2 = cut, Counter(), Counter()
        for t in texts:
            w = self.tokens(t)
            self.c1.update(w)
            self.c2.update(zip([None, *w], w))
        self.n = sum(self.c1.values())
        of = lambda c: [sum(v == r for v in c.values()) for r in range(1, cut + 2)]
        self.d1, self.d2 = discounts(of(self.c1)), discounts(of(self.c2))
        self.before = Counter()
        self.after = defaultdict(list)
        for (h, w), c in self.c2.items():
            self.before[h] += c
            self.after[h].append(w)

    @staticmethod
    def tokens(text: str | None) -> list:
        return [*GRAPHIC.findall(lower(text)), ("end",)]

    def less(self, c: int, d) -> float:
        return c * (d[c] if c <= self.cut else 1)

    def known(self, w) -> float:
        left = 1 - sum(self.less(c, self.d1) for c in self.c1.values()) / self.n if self.n else 1
        if self.n and left * self.n < 1e-6:
            return self.c1[w] / (self.n + 1) if w in self.c1 else 1 / (self.n + 1)
        return self.less(self.c1[w], self.d1) / self.n if w in self.c1 else left

    def chance(self, h, w) -> float:
        if not self.before[h]:
            return self.known(w)
        whole = self.before[h]
        left = sum(self.c2[h, x] - self.less(self.c2[h, x], self.d2) for x in self.after[h])
        if left < 1e-6:
            whole, left = whole + 1, 1
        if self.c2[h, w]:
            return self.less(self.c2[h, w], self.d2) / whole
        return left / whole * self.known(w) / (1 - sum(self.known(x) for x in self.after[h]))

    def score(self, text: str | None) -> float:
        w = self.tokens(text)
        return sum(math.log10(self.chance(h, x)) for h, x in zip([None, *w], w))
