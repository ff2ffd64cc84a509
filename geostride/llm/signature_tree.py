"""Signature trees: who links with whom among the sets of one task.

Every set has a bitmap of its tokens. Nodes of the tree hold the OR of their children's bitmaps, the range of their set
sizes, and the largest number of tokens by which a set below exceeds its own bitmap's ones. Two nodes are traversed
together; a pair of nodes is dropped when no two sets below can link: their size ranges are too far apart, or the most
that two sets could share (the common ones of both bitmaps, plus the smaller excess) is less than a link needs. A pair is
also dropped when all sets below both are in one component already, since only components are asked for. Pairs of sets
that are left are compared exactly.
"""

from __future__ import annotations

import numpy as np

from geostride.llm.graph import UnionFind

FANOUT = 8
#: Pairs of nodes that are looked at together.
FRONT = 20_000


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * common >= percent * union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


class Tree:
    def __init__(self, sets: list[np.ndarray], labels: np.ndarray | None = None, percent: int = 80):
        self.percent = percent
        #: copies lie side by side: sets that share their smallest token are neighbours
        self.order = np.array(sorted(range(len(sets)), key=lambda k: (int(sets[k][0]), len(sets[k]))))
        self.sets = [sets[k] for k in self.order]
        n = len(sets)
        self.forest = UnionFind(n)
        if labels is not None:
            seen: dict[int, int] = {}
            for k, x in enumerate(labels[self.order].tolist()):
                self.forest.union(seen.setdefault(x, k), k)
        sizes = np.array([len(s) for s in self.sets])
        bits = 1 << int(np.clip(4 * np.median(sizes), 512, 16384) - 1).bit_length()
        maps = np.zeros((n, bits // 64), np.uint64)
        for k, s in enumerate(self.sets):
            on = np.zeros(bits, np.uint8)
            on[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
            maps[k] = np.packbits(on).view(np.uint64)
        excess = sizes - np.bitwise_count(maps).sum(1)
        #: per level, leaves first: (bitmaps, least size, most size, excess, first leaf, end leaf)
        first = np.arange(n)
        self.levels = [(maps, sizes, sizes, excess, first, first + 1)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, excess, first, end = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), first[at], end[np.minimum(at + FANOUT, len(maps)) - 1]))

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        maps, low, high, excess, first, end = self.levels[level]
        p = self.percent
        ok = (100 * high[i] >= p * low[j]) & (100 * high[j] >= p * low[i])
        roots = self.forest.roots()
        if level:
            # one component below a node: its first and last leaf's roots agree with all between
            same = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
            uniform = same[end - 1] == same[first]
            ok &= ~(uniform[i] & uniform[j] & (roots[first[i]] == roots[first[j]]))
        else:
            ok &= roots[i] != roots[j]
        i, j = i[ok], j[ok]
        common = np.bitwise_count(maps[i] & maps[j]).sum(1) + np.minimum(excess[i], excess[j])
        # common >= percent / (100 + percent) of both sizes together
        ok[ok] = (100 + p) * common >= p * (low[i] + low[j])
        return ok

    def link(self) -> np.ndarray:
        """Join all linked sets; returns the smallest index (of the given order) of each set's component."""
        n = len(self.sets)
        for k in range(n - 1):
            if self.forest.find(k) != self.forest.find(k + 1) and links(self.sets[k], self.sets[k + 1], self.percent):
                self.forest.union(k, k + 1)
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, int), np.zeros(1, int))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > FRONT:
                stack += [(level, i[s : s + FRONT], j[s : s + FRONT]) for s in range(0, len(i), FRONT)][::-1]
                continue
            ok = self._possible(level, i, j) if level < top else np.ones(len(i), bool)
            i, j = i[ok], j[ok]
            if not level:
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if a != b and self.forest.find(a) != self.forest.find(b) and links(self.sets[a], self.sets[b], self.percent):
                        self.forest.union(a, b)
                continue
            below = len(self.levels[level - 1][0])
            step = np.arange(FANOUT)
            ci = (i[:, None] * FANOUT + step)[:, :, None]
            cj = (j[:, None] * FANOUT + step)[:, None, :]
            ci, cj = (x.ravel() for x in np.broadcast_arrays(ci, cj))
            keep = (ci < below) & (cj < below) & (ci <= cj)
            if len(ci := ci[keep]):
                stack.append((level - 1, ci, cj[keep]))
        roots = self.forest.roots()
        least = np.full(n, n)
        np.minimum.at(least, roots, self.order)
        out = np.empty(n, int)
        out[self.order] = least[roots]
        return out
