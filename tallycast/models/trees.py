"""Regression trees on binned rows: histograms, splits, growth level by level, walks.

Rows come as a matrix of bins (feature x row) with a gradient ``g`` and a weight ``h`` each; the
best split of a node is that of the largest gain of ``G ** 2 / (H + l2)``. A numeric feature
splits by its bin, a nominal one by a set of codes, ordered by their mean gradient. A node is
(feature, codes that go left, left, right); a leaf has feature -1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# Features whose histograms are made at once, to bound the index arrays.
CHUNK = 16


@dataclass
class Tree:
    """Nodes in order of creation; ``sums`` holds (G, H, rows) of each."""

    feature: list[int] = field(default_factory=list)
    goes_left: list[np.ndarray | None] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    sums: list[tuple[float, float, float]] = field(default_factory=list)

    def add(self, sums) -> int:
        for column, value in ((self.feature, -1), (self.goes_left, None), (self.left, -1),
                              (self.right, -1), (self.sums, tuple(map(float, sums)))):
            column.append(value)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, goes_left: np.ndarray, left, right) -> tuple[int, int]:
        self.feature[node], self.goes_left[node] = int(feature), goes_left
        self.left[node], self.right[node] = self.add(left), self.add(right)
        return self.left[node], self.right[node]

    def values(self, rate: float, l2: float) -> np.ndarray:
        """The step of each leaf."""
        return np.array([rate * g / (h + l2) if f < 0 and h + l2 > 0 else 0.0
                         for f, (g, h, _) in zip(self.feature, self.sums)])

    def descend(self, bins: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Leaf of each row, from the nodes ``at`` (the root by default) downwards."""
        at = np.zeros(bins.shape[1], np.int32) if at is None else at
        feature, left, right = map(np.array, (self.feature, self.left, self.right))
        if (feature < 0).all():
            return at
        none = np.zeros_like(next(m for m in self.goes_left if m is not None))
        member = np.array([none if m is None else m for m in self.goes_left])
        rows = np.flatnonzero(feature[at] >= 0)
        while len(rows):
            node = at[rows]
            go = member[node, bins[feature[node], rows]]
            at[rows] = np.where(go, left[node], right[node])
            rows = rows[feature[at[rows]] >= 0]
        return at


def histograms(bins: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int,
               size: int) -> np.ndarray:
    """(slot, feature, bin, 3): sums of ``g`` and ``h`` and the number of rows; rows with a
    negative slot are left out."""
    rows = np.flatnonzero(slot >= 0)
    n_features = len(bins)
    out = np.zeros((3, slots, n_features, size))
    if not len(rows):
        return np.moveaxis(out, 0, 3)
    g, h, base = g[rows], h[rows], slot[rows].astype(np.int64)
    for a in range(0, n_features, CHUNK):
        some = bins[a:a + CHUNK, rows]
        k = len(some)
        index = ((base * k)[None, :] + np.arange(k)[:, None]) * size + some
        index = index.ravel()
        for which, weight in enumerate((g, h, None)):
            weights = None if weight is None else np.tile(weight, k)
            out[which, :, a:a + k] = np.bincount(index, weights, slots * k * size).reshape(slots, k, size)
    return np.moveaxis(out, 0, 3)


@dataclass
class Split:
    gain: float
    feature: int
    goes_left: np.ndarray
    left: np.ndarray
    right: np.ndarray


def best_splits(hist: np.ndarray, nominal: np.ndarray, l2: float, min_rows: int) -> list[Split | None]:
    """The best split of each slot, None where none gains or leaves ``min_rows`` on both sides.

    Ties go to the first feature, then the first bin.
    """
    slots, _, size, _ = hist.shape
    total = hist[:, 0].sum(axis=1)
    stats, order = hist, None
    if nominal.any():
        codes = hist[:, nominal]
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(codes[..., 2] > 0, codes[..., 0] / (codes[..., 1] + l2), np.inf)
        order = np.argsort(mean, axis=2, kind="stable")
        stats = hist.copy()
        stats[:, nominal] = np.take_along_axis(codes, order[..., None], axis=2)
    left = np.cumsum(stats, axis=2)[:, :, :-1]
    right = total[:, None, None, :] - left

    def score(part):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(part[..., 1] + l2 > 0, part[..., 0] ** 2 / (part[..., 1] + l2), 0.0)

    gain = score(left) + score(right) - score(total)[:, None, None]
    gain[(left[..., 2] < min_rows) | (right[..., 2] < min_rows)] = -np.inf
    found = []
    for s, at in enumerate(gain.reshape(slots, -1).argmax(axis=1).tolist()):
        feature, cut = divmod(at, size - 1)
        if not gain[s, feature, cut] > 0:
            found.append(None)
            continue
        goes_left = np.zeros(size, bool)
        if nominal[feature]:
            which = int(nominal[:feature].sum())
            goes_left[order[s, which, :cut + 1]] = True
        else:
            goes_left[:cut + 1] = True
        found.append(Split(float(gain[s, feature, cut]), feature, goes_left,
                           left[s, feature, cut], right[s, feature, cut]))
    return found


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, used: np.ndarray, nominal: np.ndarray,
         size: int, depth: int, l2: float, min_rows: int) -> tuple[Tree, np.ndarray]:
    """A tree on the ``used`` rows, and the leaf of every row.

    Of two children only the one with fewer rows is counted; the other is the rest of its parent.
    """
    tree = Tree()
    at = np.zeros(bins.shape[1], np.int32)
    hist = histograms(bins, np.where(used, 0, -1), g, h, 1, size)
    frontier = [tree.add(hist[0, 0].sum(axis=0))]
    for level in range(depth):
        splits = best_splits(hist, nominal, l2, min_rows) if frontier else []
        children = []
        for s, (node, split) in enumerate(zip(frontier, splits)):
            if split is not None:
                left, right = tree.split(node, split.feature, split.goes_left, split.left, split.right)
                children.append((s, *((left, right) if split.left[2] <= split.right[2] else (right, left))))
        if not children:
            break
        at = tree.descend(bins, at)
        if level + 1 == depth:
            break
        slot = np.full(len(tree.feature), -1)
        slot[[small for _, small, _ in children]] = np.arange(len(children))
        small = histograms(bins, np.where(used, slot[at], -1), g, h, len(children), size)
        large = hist[[s for s, _, _ in children]] - small
        pairs = np.concatenate([small, large])
        nodes = [a for _, a, _ in children] + [b for _, _, b in children]
        open_ = [i for i, n in enumerate(nodes) if tree.sums[n][2] >= 2 * min_rows]
        frontier, hist = [nodes[i] for i in open_], pairs[open_]
    return tree, at
