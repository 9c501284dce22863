"""A bounding-volume hierarchy as flat arrays: several builders, one vectorised traversal.

The tree only prunes; results never depend on it.  It is built once over a block of bounded size and sent to the
executors, which run whole Arrow batches of query points through it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .spatial import SPAN, hilbert_codes

BRANCHES, LEAF, SAH_BINS, CLUSTER = 4, 16, 32, 8


def _extent(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return hi.max(0) - lo.min(0)


def _area(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    x, y, z = (hi - lo).T
    return 2 * (x * y + y * z + z * x)


def equal_counts(order: np.ndarray, parts: int) -> list[np.ndarray]:
    """Chunks whose sizes differ by one at most, the first ones taking the remainder."""
    return [c for c in np.array_split(order, parts) if len(c)]


def by_centroid(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, parts: int) -> list[np.ndarray]:
    """Sorted along the longest axis of the centroids (ties by id), in equal counts."""
    c = (lo[ids] + hi[ids]) / 2
    axis = int((c.max(0) - c.min(0)).argmax())
    return equal_counts(ids[np.lexsort((ids, c[:, axis]))], parts)


def _halves(split: Callable, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, parts: int) -> list[np.ndarray]:
    """``parts`` chunks by splitting the largest chunk in two again and again."""
    chunks = [ids]
    while len(chunks) < parts:
        i = max(range(len(chunks)), key=lambda j: len(chunks[j]))
        if len(chunks[i]) < 2:
            break
        chunks[i : i + 1] = split(chunks[i], lo, hi)
    return chunks


def _midpoint2(ids, lo, hi):
    c = (lo[ids] + hi[ids]) / 2
    axis = int((c.max(0) - c.min(0)).argmax())
    low = c[:, axis] < (c[:, axis].min() + c[:, axis].max()) / 2
    return [ids[low], ids[~low]] if low.any() and not low.all() else by_centroid(ids, lo, hi, 2)


def _sah2(ids, lo, hi, longest_only: bool = False):
    """The cheapest of the bin borders by surface area times count; the middle if none parts the ids."""
    a, b = lo[ids], hi[ids]
    c = (a + b) / 2
    spans = c.max(0) - c.min(0)
    best = None
    for axis in [int(spans.argmax())] if longest_only else range(3):
        if spans[axis] <= 0:
            continue
        bin_of = np.minimum(((c[:, axis] - c[:, axis].min()) / spans[axis] * SAH_BINS).astype(int), SAH_BINS - 1)
        lows, highs = np.full((SAH_BINS, 3), np.inf), np.full((SAH_BINS, 3), -np.inf)
        np.minimum.at(lows, bin_of, a)
        np.maximum.at(highs, bin_of, b)
        n = np.cumsum(np.bincount(bin_of, minlength=SAH_BINS))[:-1]
        left = np.minimum.accumulate(lows)[:-1], np.maximum.accumulate(highs)[:-1]
        right = np.minimum.accumulate(lows[::-1])[::-1][1:], np.maximum.accumulate(highs[::-1])[::-1][1:]
        ok = (n > 0) & (n < len(ids))
        if ok.any():
            cost = np.where(ok, 0.0, np.inf)
            cost[ok] = _area(left[0][ok], left[1][ok]) * n[ok] + _area(right[0][ok], right[1][ok]) * (len(ids) - n[ok])
            i = int(cost.argmin())
            if best is None or cost[i] < best[0]:
                best = (cost[i], bin_of <= i)
    if best is None:
        return by_centroid(ids, lo, hi, 2)
    return [ids[best[1]], ids[~best[1]]]


def curve_codes(lo: np.ndarray, hi: np.ndarray, curve: str) -> np.ndarray:
    c = (lo + hi) / 2
    low, width = c.min(0), c.max(0) - c.min(0)
    cells = np.minimum((c - low) / np.where(width > 0, width, 1) * (SPAN + 1), SPAN).astype(np.int64)
    if curve == "hilbert":
        return hilbert_codes(cells)
    if curve == "nested":
        return cells[:, 0] | cells[:, 1] << 21 | cells[:, 2] << 42
    code = np.zeros(len(cells), np.int64)
    for bit in range(21):
        for axis in range(3):
            code |= (cells[:, axis] >> bit & 1) << (3 * bit + axis)
    return code


PARTITIONERS: dict[str, Callable] = {
    "centroid": by_centroid,
    "midpoint": lambda i, lo, hi, k: _halves(_midpoint2, i, lo, hi, k),
    "sah": lambda i, lo, hi, k: _halves(_sah2, i, lo, hi, k),
    "sah_longest": lambda i, lo, hi, k: _halves(lambda a, b, c: _sah2(a, b, c, True), i, lo, hi, k),
}
CURVES = ("morton", "nested", "hilbert")
BUILDS = (*PARTITIONERS, *CURVES, "cluster_sah")


class Bvh:
    """Nodes in depth-first order: box, first child and end of subtree, and for leaves a range of ``ids``."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, build: str = "sah", leaf: int | Callable[[np.ndarray], bool] = LEAF, branches: int = BRANCHES):
        """``leaf`` is the most primitives of a leaf, or a predicate that tells of a node's primitives whether it is one."""
        if build not in BUILDS:
            raise ValueError(f"build must be one of {BUILDS}")
        ends = leaf if callable(leaf) else lambda own, most=leaf: len(own) <= most
        leaf = LEAF if callable(leaf) else leaf
        lo, hi = np.asarray(lo, float), np.asarray(hi, float)
        self.children: list[list[int]] = []
        self.ranges: list[tuple[int, int]] = []
        ids: list[np.ndarray] = []
        self._n = 0

        def grow(own: np.ndarray, split: Callable, stop: Callable[[np.ndarray], bool], unpack: Callable) -> int:
            node = len(self.children)
            self.children.append([])
            self.ranges.append((0, 0))
            if len(own) <= 1 or stop(own):
                found = unpack(own)
                ids.append(found)
                self.ranges[node] = (self._n, self._n + len(found))
                self._n += len(found)
            else:
                self.children[node] = [grow(p, split, stop, unpack) for p in split(own)]
            return node

        every = np.arange(len(lo))
        if len(lo) == 0:
            pass
        elif build in CURVES:
            order = every[np.lexsort((every, curve_codes(lo, hi, build)))]
            grow(order, lambda own: equal_counts(own, branches), ends, lambda own: own)
        elif build == "cluster_sah":
            order = every[np.lexsort((every, curve_codes(lo, hi, "morton")))]
            groups = [order[i : i + CLUSTER] for i in range(0, len(order), CLUSTER)]
            glo, ghi = np.array([lo[g].min(0) for g in groups]), np.array([hi[g].max(0) for g in groups])
            split = PARTITIONERS["sah"]
            grow(np.arange(len(groups)), lambda own: split(own, glo, ghi, branches), lambda own: len(own) <= max(1, leaf // CLUSTER), lambda own: np.concatenate([groups[g] for g in own]))
        else:
            split = PARTITIONERS[build]
            grow(every, lambda own: split(own, lo, hi, branches), ends, lambda own: own)
        self.ids = np.concatenate(ids) if ids else np.empty(0, int)
        self.refit(lo, hi)

    def refit(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """New boxes of moved primitives in the same tree."""
        n = len(self.children)
        self.lo, self.hi = np.full((n, 3), np.inf), np.full((n, 3), -np.inf)
        for node in range(n - 1, -1, -1):
            a, b = self.ranges[node]
            own = self.ids[a:b]
            lows = [lo[own]] if len(own) else [self.lo[c][None] for c in self.children[node]]
            highs = [hi[own]] if len(own) else [self.hi[c][None] for c in self.children[node]]
            self.lo[node], self.hi[node] = np.concatenate(lows).min(0), np.concatenate(highs).max(0)

    def distance2(self, node: int, points: np.ndarray) -> np.ndarray:
        d = np.maximum(np.maximum(self.lo[node] - points, points - self.hi[node]), 0)
        return np.einsum("ij,ij->i", d, d)

    def is_leaf(self, node: int) -> bool:
        return not self.children[node]

    def primitives(self, node: int) -> np.ndarray:
        """The primitives of a leaf."""
        a, b = self.ranges[node]
        return self.ids[a:b]

    def box(self, node: int = 0) -> tuple[np.ndarray, np.ndarray]:
        return self.lo[node], self.hi[node]

    def packed(self, convert: Callable[[np.ndarray], object]) -> list:
        """What ``convert`` makes of each leaf's primitives, by node (None for inner nodes): leaves in another form, such as
        their coordinates side by side."""
        return [convert(self.primitives(n)) if self.is_leaf(n) else None for n in range(len(self.children))]

    def traverse(self, evaluate: Callable[[int, np.ndarray], None], enter: Callable[[int, object], bool], key: Callable[[int], object], order: Callable[[list[tuple[int, object]]], list[tuple[int, object]]] = list) -> None:
        """A walk by the caller's rules: ``key(node)`` is made once for each node that is met, ``enter(node, key)`` tells
        whether to go on into it when its turn comes, ``order`` sorts the (child, key) pairs of a node, and
        ``evaluate(node, primitives)`` is called for the leaves that are entered."""
        stack = [(0, key(0))] if self.children else []
        while stack:
            node, own = stack.pop()
            if not enter(node, own):
                continue
            if self.is_leaf(node):
                evaluate(node, self.primitives(node))
            else:
                stack += reversed(order([(c, key(c)) for c in self.children[node]]))

    def visit(self, points: np.ndarray, bound2: Callable[[np.ndarray], np.ndarray], leaf: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Calls ``leaf(rows of points, primitive ids)`` for each leaf that lies within the rows' current squared bound;
        near children come first, and ``leaf`` may lower the bounds."""
        if not self.children or not len(points):
            return
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            rows = rows[self.distance2(node, points[rows]) <= bound2(rows)]
            if not len(rows):
                continue
            a, b = self.ranges[node]
            if b > a:
                leaf(rows, self.ids[a:b])
                continue
            center = points[rows].mean(0, keepdims=True)
            near = sorted(self.children[node], key=lambda c: -self.distance2(c, center)[0])
            stack += [(c, rows) for c in near]
