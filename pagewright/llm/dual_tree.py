"""Trees over blocks of integer vectors, and the search of one forest by another.

A node knows the box and the ball around its vectors, so two nodes bound all inner
products between them.  A search walks pairs of an anchor node and candidate nodes
and gives up those whose interval no anchor below can use; leaves are scored exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 64
_NONE = np.iinfo(np.int64).min


@dataclass
class Tree:
    """A tree over rows ``ids`` and ``x``; node i holds rows first[i] to last[i], its children are i + 1 and right[i] (0: a leaf)."""

    dim: int
    label: str
    ids: np.ndarray
    x: np.ndarray
    first: np.ndarray
    last: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def split_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The line between two far points, where each row lies on it, and the median there."""
    middle = x.mean(axis=0)
    one = x[np.argmax(((x - middle) ** 2).sum(axis=1))]
    line = x[np.argmax(((x - one) ** 2).sum(axis=1))] - one
    at = x @ line
    return line, at, float(np.median(at))


def build(label: str, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree of some rows of one length, at least one, and the order in which it holds them."""
    values = x.astype(np.float64)
    order = np.arange(len(ids))
    nodes: list[list[int]] = []
    open_ = [(0, len(ids), -1)]
    while open_:
        start, end, parent = open_.pop()
        if parent >= 0:
            nodes[parent][2] = len(nodes)
        me = len(nodes)
        nodes.append([start, end, 0])
        if end - start > leaf:
            half = (start + end) // 2
            own = order[start:end]
            at = split_order(values[own])[1]
            order[start:end] = own[np.argpartition(at, half - start)]
            open_ += [(half, end, me), (start, half, -1)]
    first, last, right = np.array(nodes, np.int64).reshape(-1, 3).T
    values = values[order]
    box = [(values[a:b].min(axis=0), values[a:b].max(axis=0)) for a, b in zip(first, last, strict=True)]
    low, high = np.array([b[0] for b in box]), np.array([b[1] for b in box])
    centre = np.array([values[a:b].mean(axis=0) for a, b in zip(first, last, strict=True)])
    radius = np.array([np.sqrt(((values[a:b] - c) ** 2).sum(axis=1)).max() for a, b, c in zip(first, last, centre, strict=True)])
    return Tree(x.shape[1], label, ids[order], x[order], first, last, right, low, high, centre, radius), order


class Forest:
    """The nodes of several trees of one length side by side."""

    def __init__(self, trees: list[Tree]):
        nodes = np.cumsum([0, *(len(t.first) for t in trees)])
        held = np.cumsum([0, *(len(t.ids) for t in trees)])
        self.roots, self.labels = nodes[:-1], np.array([t.label for t in trees], object)
        self.ids, self.x = np.concatenate([t.ids for t in trees]), np.concatenate([t.x for t in trees])
        self.first, self.last = (np.concatenate([getattr(t, name) + held[i] for i, t in enumerate(trees)]) for name in ("first", "last"))
        self.right = np.concatenate([np.where(t.right > 0, t.right + nodes[i], 0) for i, t in enumerate(trees)])
        self.low, self.high, self.centre, self.radius = (np.concatenate([getattr(t, name) for t in trees]) for name in ("low", "high", "centre", "radius"))
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        self.largest = float(np.abs(self.x).max(initial=0))

    def children(self, nodes: np.ndarray) -> np.ndarray:
        """The children of inner nodes, and leaves as they are."""
        inner = self.right[nodes] > 0
        return np.concatenate([nodes[~inner], nodes[inner] + 1, self.right[nodes[inner]]])


def intervals(anchors: Forest, a: int, candidates: Forest, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all inner products between vectors below anchor node ``a`` and below each of ``nodes``."""
    low, high = candidates.low[nodes], candidates.high[nodes]
    ends = np.stack([anchors.low[a] * low, anchors.low[a] * high, anchors.high[a] * low, anchors.high[a] * high])
    middle = candidates.centre[nodes] @ anchors.centre[a]
    slack = anchors.radius[a] * candidates.norm[nodes] + candidates.radius[nodes] * (anchors.norm[a] + anchors.radius[a])
    upper = np.minimum(ends.max(axis=0).sum(axis=1), middle + slack)
    lower = np.maximum(ends.min(axis=0).sum(axis=1), middle - slack)
    margin = 1e-9 * (np.abs(middle) + slack + np.abs(upper) + np.abs(lower)) + 1e-3  # for rounding
    return lower - margin, upper + margin


class Search:
    """The first ``k`` candidates of each anchor in each of its bands, by score downwards and then by id.

    ``low`` and ``high`` have a row for each anchor and a column for each band, ends
    included.  Candidates are of the anchor's label if ``same``, else of others; rows
    with the anchor's own id are passed over.
    """

    def __init__(self, anchors: Forest, candidates: Forest, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.anchors, self.candidates, self.k = anchors, candidates, k
        self.least, self.high = low.copy(), high
        self.least_id = np.full(low.shape, np.iinfo(np.int64).max)
        self.scores = np.full((*low.shape, k), _NONE)
        self.found = np.zeros((*low.shape, k), np.int64)
        self.pairs_scored = 0
        self.whole = anchors.largest * candidates.largest * max(1, anchors.x.shape[1]) >= 2.0**53
        for root, label in zip(anchors.roots, anchors.labels, strict=True):
            wanted = (candidates.labels == label) == same
            self._visit(int(root), candidates.roots[wanted])

    def _open(self, a: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``nodes`` that an anchor below ``a`` may still use, with their upper bounds."""
        rows = slice(self.anchors.first[a], self.anchors.last[a])
        least, high = self.least[rows], self.high[rows]
        usable = least <= high
        if not usable.any() or not len(nodes):
            return nodes[:0], np.zeros(0)
        lower, upper = intervals(self.anchors, a, self.candidates, nodes)
        kept = (upper >= least[usable].min()) & (lower <= high[usable].max())
        return nodes[kept], upper[kept]

    def _visit(self, a: int, nodes: np.ndarray) -> None:
        stack = [(a, nodes)]
        while stack:
            a, nodes = stack.pop()
            nodes, upper = self._open(a, nodes)
            if not len(nodes):
                continue
            right, below = self.anchors.right[a], self.candidates.children(nodes)
            if right:
                stack += [(int(right), below), (a + 1, below)]
            elif len(below) > len(nodes):
                stack.append((a, below))
            else:
                self._leaves(a, nodes[np.argsort(-upper, kind="stable")])

    def _leaves(self, a: int, leaves: np.ndarray, at_once: int = 8) -> None:
        for i in range(0, len(leaves), at_once):
            some, _ = self._open(a, leaves[i : i + at_once])
            if len(some):
                self._score(a, np.concatenate([np.arange(self.candidates.first[c], self.candidates.last[c]) for c in some]))

    def _score(self, a: int, held: np.ndarray) -> None:
        first, last = self.anchors.first[a], self.anchors.last[a]
        one, other, ids = self.anchors.x[first:last], self.candidates.x[held], self.candidates.ids[held]
        scores = one.astype(np.int64) @ other.astype(np.int64).T if self.whole else (one.astype(np.float64) @ other.astype(np.float64).T).astype(np.int64)
        self.pairs_scored += scores.size
        others = self.anchors.ids[first:last, None] != ids
        for band in range(self.least.shape[1]):
            least = self.least[first:last, band, None]
            fit = (scores >= least) & (scores <= self.high[first:last, band, None]) & others
            fit &= (scores > least) | (ids < self.least_id[first:last, band, None])
            for row in np.flatnonzero(fit.any(axis=1)):
                self._take(first + row, band, scores[row, fit[row]], ids[fit[row]])

    def _take(self, row: int, band: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[row, band], scores]), np.concatenate([self.found[row, band], ids])
        best = np.lexsort((ids, -np.maximum(scores, _NONE + 1), scores == _NONE))[: self.k]
        self.scores[row, band], self.found[row, band] = scores[best], ids[best]
        if scores[best[-1]] != _NONE:
            self.least[row, band], self.least_id[row, band] = scores[best[-1]], ids[best[-1]]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row of the anchor, band, score and id of all that was found."""
        row, band, place = np.nonzero(self.scores != _NONE)
        return row, band, self.scores[row, band, place], self.found[row, band, place]
