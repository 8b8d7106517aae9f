"""Gradient-boosted trees on a bounded sample: histogram splits, logistic loss, and isotonic calibration on held-out rows."""

from __future__ import annotations

import numpy as np


def fit_tree(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, l2: float, least: float):
    """A complete tree as arrays: feature and bin of each inner node (go right where bin > threshold), value of each leaf."""
    nodes = 2**depth - 1
    feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, 255, np.int64)
    where = np.zeros(len(binned), np.int64)
    for level in range(depth):
        for node in range(2**level - 1, 2 ** (level + 1) - 1):
            rows = np.flatnonzero(where == node)
            best = (1e-9, 0, 255)
            if len(rows):
                g, h = gradient[rows], hessian[rows]
                G, H = g.sum(), h.sum()
                for f in range(binned.shape[1]):
                    b = binned[rows, f]
                    gl, hl = np.cumsum(np.bincount(b, g, 256))[:-1], np.cumsum(np.bincount(b, h, 256))[:-1]
                    ok = (hl >= least) & (H - hl >= least)
                    gain = np.where(ok, gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
            feature[node], threshold[node] = best[1], best[2]
            where[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[2])
    leaf = where - nodes
    G, H = np.bincount(leaf, gradient, nodes + 1), np.bincount(leaf, hessian, nodes + 1)
    return feature, threshold, -G / (H + l2)


class Boosted:
    """Boosted trees with their bin edges and an isotonic calibration; small, and pickled to the workers."""

    def __init__(self, edges, trees, base, rate, steps, levels):
        self.edges, self.trees, self.base, self.rate, self.steps, self.levels = edges, trees, base, rate, steps, levels
        self.limits = None  # thresholds of the probability, where a user of the trees sets some

    @staticmethod
    def bins(x: np.ndarray, edges) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1).astype(np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out = self.bins(x, self.edges), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (binned[rows, feature[node]] > threshold[node])
            out += self.rate * value[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability, a step function of the raw score."""
        if not len(x):
            return np.zeros(0)
        return self.levels[np.maximum(np.searchsorted(self.steps, self.raw(x), "right") - 1, 0)]


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the first score and the level of each step."""
    order = np.argsort(score, kind="stable")
    weight = np.ones(len(y)) if weight is None else weight
    blocks: list[list[float]] = []  # first score, sum, weight
    for s, v, w in zip(score[order].tolist(), (y * weight)[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([s, v, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s, v, c = blocks.pop()
            blocks[-1][1] += v
            blocks[-1][2] += c
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, l2: float = 1.0, least: float = 5.0, weight: np.ndarray | None = None) -> Boosted:
    """Fit on the rows not held out, calibrate on those that are (on all, if the held-out ones are of one class)."""
    weight = np.ones(len(y)) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    train = ~held if len(set(y[~held])) > 1 else np.ones(len(y), bool)
    binned, t = Boosted.bins(x[train], edges), y[train].astype(float)
    w = weight[train]
    mean = min(max(np.average(t, weights=w), 1e-3), 1 - 1e-3)
    base, out = float(np.log(mean / (1 - mean))), []
    score = np.full(len(t), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = fit_tree(binned, (p - t) * w, np.maximum(p * (1 - p), 1e-6) * w, depth, l2, least)
        out.append(tree)
        node, rows = np.zeros(len(t), np.int64), np.arange(len(t))
        for _ in range(depth):
            node = 2 * node + 1 + (binned[rows, tree[0][node]] > tree[1][node])
        score += rate * tree[2][node - len(tree[0])]
    model = Boosted(edges, out, base, rate, np.zeros(1), np.zeros(1))
    on = held if len(set(y[held])) > 1 else np.ones(len(y), bool)
    model.steps, model.levels = isotonic(model.raw(x[on]), y[on].astype(float), weight[on])
    return model
