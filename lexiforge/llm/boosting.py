"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints, and
flat node arrays for vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Forest:
    """All nodes of all trees in flat arrays.  A leaf points at itself, so a walk of ``depth``
    steps from each root ends at a leaf."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


@dataclass
class _Nodes:
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        k = len(self.value)
        self.feature.append(0)
        self.threshold.append(np.inf)
        self.left.append(k)
        self.right.append(k)
        self.value.append(value)
        return k


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, min_rows: int = 10) -> Forest:
    """Boosted trees for P(y = 1).  monotone: per feature +1 (the score may not fall as the feature
    grows), -1 (may not rise) or 0 (free).

    A split on a constrained feature must have its leaf weights in order; its children then keep to
    either side of the weights' middle, so the order holds for all rows of the whole tree."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1)
    rate_pos = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    base = float(np.log(rate_pos / (1 - rate_pos)))
    margin = np.full(n, base)
    nodes, roots = _Nodes(), []

    def weight(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + l2), low), high)

    def gain(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return -(2 * g * w + (h + l2) * w * w)

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, left_depth: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        w = weight(g, h, low, high)
        k = nodes.add(w * rate)
        if left_depth == 0 or len(rows) < 2 * min_rows:
            return k
        best = (1e-6, -1, -1, 0.0, 0.0)
        here = gain(g, h, np.float64(w))
        for f in range(width):
            m = len(edges[f]) + 1
            if m < 2:
                continue
            b = binned[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, v, m))[:-1] for v in (grad[rows], hess[rows], None))
            gr, hr, nr = g - gl, h - hl, len(rows) - nl
            wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            good = (nl >= min_rows) & (nr >= min_rows) & (monotone[f] * (wr - wl) >= 0)
            score = np.where(good, gain(gl, hl, wl) + gain(gr, hr, wr) - here, -np.inf)
            c = int(score.argmax())
            if score[c] > best[0]:
                best = (float(score[c]), f, c, float(wl[c]), float(wr[c]))
        _, f, c, wl, wr = best
        if f < 0:
            return k
        goes = binned[rows, f] <= c
        mid = (wl + wr) / 2
        bounds_l, bounds_r = (low, high), (low, high)
        if monotone[f] > 0:
            bounds_l, bounds_r = (low, mid), (mid, high)
        elif monotone[f] < 0:
            bounds_l, bounds_r = (mid, high), (low, mid)
        nodes.feature[k], nodes.threshold[k] = f, float(edges[f][c])
        nodes.left[k] = grow(rows[goes], grad, hess, left_depth - 1, *bounds_l)
        nodes.right[k] = grow(rows[~goes], grad, hess, left_depth - 1, *bounds_r)
        return k

    def forest(picked: list[int]) -> Forest:
        return Forest(np.array(picked, np.int64), np.array(nodes.feature, np.int64), np.array(nodes.threshold), np.array(nodes.left, np.int64), np.array(nodes.right, np.int64), np.array(nodes.value), depth, base)

    everything = np.arange(n)
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        roots.append(grow(everything, p - y, p * (1 - p), depth, -np.inf, np.inf))
        margin += Forest.margin(forest(roots[-1:]), x) - base
    return forest(roots)
