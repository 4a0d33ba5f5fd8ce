"""Levenshtein distance for batches of pairs, and a BK-tree that searches whole batches at once.

The distance is the plain edit metric (insert, delete, substitute), computed bit-parallel over one
64-bit word per pair; patterns over 64 characters use Python integers of any width instead.
"""

from __future__ import annotations

import numpy as np

WORD = 64
ONE = np.uint64(1)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def distance(a: str, b: str) -> int:
    """Edit distance of two strings of any length."""
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, ch in enumerate(a):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for ch in b:
        eq = peq.get(ch, 0)
        xv = eq | down
        xh = ((((eq & up) + up) & full) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & full, up & xh
        score += (ph & top > 0) - (mh & top > 0)
        ph, mh = ((ph << 1) | 1) & full, (mh << 1) & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
    return score


class Patterns:
    """Strings prepared as the fixed side of many comparisons."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        alphabet = sorted({c for s in strings for c in s})
        self.code = {c: i for i, c in enumerate(alphabet)}  # any other character matches nothing
        self.other = len(alphabet)
        self.size = np.array([len(s) for s in strings], dtype=np.int64)
        self.peq = np.zeros((len(strings), len(alphabet) + 1), dtype=np.uint64)
        for k, s in enumerate(strings):
            for i, c in enumerate(s[:WORD]):
                self.peq[k, self.code[c]] |= ONE << np.uint64(i)
        self.top = ONE << (np.clip(self.size, 1, WORD) - 1).astype(np.uint64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(t) for t in texts], dtype=np.int64)
        codes = np.full((len(texts), int(size.max(initial=0))), self.other, dtype=np.int64)
        for k, t in enumerate(texts):
            codes[k, : len(t)] = [self.code.get(c, self.other) for c in t]
        return codes, size

    def distances(self, which: np.ndarray, texts: list[str], codes: np.ndarray, size: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Distance of pattern ``which[i]`` to text ``row[i]`` for every i."""
        n, top = self.size[which], self.top[which]
        score = n.copy()
        up = np.full(len(which), ALL, dtype=np.uint64)
        down = np.zeros(len(which), dtype=np.uint64)
        mine = size[row]
        for j in range(int(mine.max(initial=0))):
            live = j < mine
            eq = self.peq[which, codes[row, j]]
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | ~(xh | up), up & xh
            score += live & ((ph & top) != 0)
            score -= live & ((mh & top) != 0)
            ph, mh = (ph << ONE) | ONE, mh << ONE
            up, down = mh | ~(xv | ph), ph & xv
        score = np.where(n == 0, mine, score)
        for i in np.flatnonzero(n > WORD):
            score[i] = distance(self.strings[which[i]], texts[row[i]])
        return score


class BKTree:
    """Metric tree over strings; a search returns every entry within the query's threshold."""

    def __init__(self, strings: list[str]):
        strings = list(dict.fromkeys(strings))
        self.patterns = Patterns(strings)
        kids: list[dict[int, int]] = [{} for _ in strings]
        for k in range(1, len(strings)):
            at = 0
            while True:
                d = distance(strings[at], strings[k])
                if d not in kids[at]:
                    kids[at][d] = k
                    break
                at = kids[at][d]
        self.start = np.cumsum([0] + [len(c) for c in kids])
        self.child = np.array([v for c in kids for v in c.values()], dtype=np.int64)
        self.edge = np.array([d for c in kids for d in c], dtype=np.int64)

    def search(self, texts: list[str], within: np.ndarray, block: int = 512):
        """Yield ``(text index, entry, distance)`` of every entry within ``within[text index]``."""
        strings = self.patterns.strings
        if not strings:
            return
        for at in range(0, len(texts), block):
            part = texts[at : at + block]
            codes, size = self.patterns.encode(part)
            row, node = np.arange(len(part)), np.zeros(len(part), dtype=np.int64)
            while len(row):
                d = self.patterns.distances(node, part, codes, size, row)
                t = within[at + row]
                for i in np.flatnonzero(d <= t):
                    yield at + int(row[i]), strings[node[i]], int(d[i])
                many = self.start[node + 1] - self.start[node]
                which = np.repeat(np.arange(len(row)), many)
                kid = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + self.start[node][which]
                ok = np.abs(self.edge[kid] - d[which]) <= t[which]  # triangle inequality
                row, node = row[which][ok], self.child[kid[ok]]
