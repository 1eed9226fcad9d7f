"""Gradient-boosted symmetric trees with a softmax over classes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Every tree asks the same question at each node of a level, so a row's leaf is a few comparisons."""

    features: np.ndarray  # trees x depth
    limits: np.ndarray  # trees x depth
    leaves: np.ndarray  # trees x classes x 2 ** depth
    start: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.repeat(self.start[None], len(x), 0)
        columns = np.ascontiguousarray(x.T)
        for features, limits, leaves in zip(self.features, self.limits, self.leaves):
            leaf = np.zeros(len(x), np.int64)
            for level, (f, limit) in enumerate(zip(features, limits)):
                leaf |= (columns[f] > limit).astype(np.int64) << level
            out += leaves[:, leaf].T
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.log_odds(x)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def fit(x: np.ndarray, y: np.ndarray, classes: int, trees: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 32, l2: float = 1.0, columns: float = 0.4, seed: int = 5) -> Trees:
    """Boosting on quantile bins: one tree a round, from a share of the columns; its leaves hold a step for every class."""
    pick = np.random.Generator(np.random.PCG64(seed))
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)])
    n_features = len(binned)
    prior = np.log(np.bincount(y, minlength=classes) + 1.0)
    start = prior - np.log(np.exp(prior).sum())
    z = np.repeat(start[None], len(x), 0)
    target = np.eye(classes)[y]
    out_f, out_l, out_v = [], [], []
    for _ in range(trees):
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g, h = target - p, p * (1 - p)
        leaf = np.zeros(len(x), np.int64)
        features, limits = [], []
        tried = np.sort(pick.choice(n_features, max(1, round(n_features * columns)), replace=False))
        for level in range(depth):
            size = (1 << level) * bins
            best = (-1.0, 0, 0)
            for f in tried:
                at = leaf * bins + binned[f]
                gain = 0.0
                for k in range(classes):
                    gs = np.bincount(at, g[:, k], size).reshape(-1, bins).cumsum(1)
                    hs = np.bincount(at, h[:, k], size).reshape(-1, bins).cumsum(1)
                    gl, hl = gs[:, :-1], hs[:, :-1]
                    gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                    gain = gain + (gl**2 / (hl + l2) + gr**2 / (hr + l2)).sum(0)
                gain = gain[: len(cuts[f])]
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), int(f), int(gain.argmax()))
            _, f, b = best
            features.append(f)
            limits.append(cuts[f][b] if len(cuts[f]) else np.inf)
            leaf |= (x[:, f] > limits[-1]).astype(np.int64) << level
        values = np.stack([rate * np.bincount(leaf, g[:, k], 1 << depth) / (np.bincount(leaf, h[:, k], 1 << depth) + l2) for k in range(classes)])
        z += values[:, leaf].T
        out_f.append(features)
        out_l.append(limits)
        out_v.append(values)
    return Trees(np.array(out_f), np.array(out_l), np.array(out_v), start)
