"""Gradient-boosted regression trees for bounded training samples, flattened into node arrays; isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees as arrays of shape (trees, nodes): node i has children 2 i + 1 and 2 i + 2; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds; a level of all rows at a time."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > threshold[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray | None = None, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss on binned features.

    signs: for each feature +1 (the score may only rise with it), -1 (only fall) or 0. A split of such a feature is taken
    only if its children's values are in that order, and the children are then held to either side of their mean.
    Without rows there are no trees, and the log-odds are 0.
    """
    n, width = x.shape
    if not n:
        return Forest(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)), 0.0)
    signs = np.zeros(width, int) if signs is None else np.asarray(signs)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    raw = np.full(n, start)
    nodes = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        for node in range(nodes):
            mine = np.flatnonzero(at == node)
            if not len(mine):
                continue
            g, h = grad[mine], hess[mine]
            best = (1e-6, -1, 0, 0.0, 0.0)
            total_g, total_h = g.sum(), h.sum()
            value[t, node] = rate * np.clip(total_g / (total_h + ridge), low[node], high[node])
            if 2 * node + 2 < nodes and len(mine) >= 2 * least:
                for j in range(width):
                    if not len(edges[j]):
                        continue
                    b = binned[mine, j]
                    size = len(edges[j]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g, h, None))
                    gr, hr = total_g - gl, total_h - hl
                    vl, vr = np.clip(gl / (hl + ridge), low[node], high[node]), np.clip(gr / (hr + ridge), low[node], high[node])
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total_g**2 / (total_h + ridge)
                    gain[(nl < least) | (len(mine) - nl < least) | (signs[j] * (vr - vl) < 0)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k, vl[k], vr[k])
            _, j, k, vl, vr = best
            if j < 0:
                continue
            feature[t, node], threshold[t, node] = j, edges[j][k]
            left, right = 2 * node + 1, 2 * node + 2
            for child in (left, right):
                low[child], high[child] = low[node], high[node]
            if signs[j]:
                middle = (vl + vr) / 2
                (high if signs[j] > 0 else low)[left] = middle
                (low if signs[j] > 0 else high)[right] = middle
            at[mine] = np.where(binned[mine, j] > k, right, left)
        raw += value[t][at]
    return Forest(feature, threshold, value, start)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising step curve from score to the share of ones."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, last score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([float(v), 1.0, s])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][2] == blocks[-1][2]):
            m, w, last = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + m * w) / (a[1] + w), a[1] + w, last
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])
