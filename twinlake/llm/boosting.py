"""Gradient-boosted trees for a few classes, on binned numbers and on sets of tokens."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: at each inner place a feature and the largest bin that goes left."""

    edges: np.ndarray  # a row a number: ascending bounds of its bins
    feature: np.ndarray  # rounds x classes x (2 ** depth - 1)
    bound: np.ndarray
    leaf: np.ndarray  # rounds x classes x 2 ** depth
    prior: np.ndarray

    def bins(self, numbers: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, numbers.T, strict=True)], 1).astype(np.uint8)

    def step(self, t: int, c: int, place: np.ndarray, x: np.ndarray) -> np.ndarray:
        """One level down in a tree, for rows of bins and flags."""
        return 2 * place + 1 + (x[np.arange(len(x)), self.feature[t, c][place]] > self.bound[t, c][place])

    def log_odds(self, numbers: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """Class scores of rows; numbers: floats, flags: booleans."""
        x = np.concatenate([self.bins(numbers), flags.view(np.uint8)], 1)
        out, inner = np.tile(self.prior, (len(x), 1)), self.feature.shape[2]
        for t in range(len(self.leaf)):
            for c in range(out.shape[1]):
                place = np.zeros(len(x), np.int64)
                while len(place) and place[0] < inner:
                    place = self.step(t, c, place, x)
                out[:, c] += self.leaf[t, c][place - inner] if len(place) else 0
        return out


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def boost(
    numbers: np.ndarray, flags: np.ndarray, y: np.ndarray, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.2,
    ridge: float = 2.0, least: int = 10, bins: int = 32, share: float = 0.5,
) -> Trees:
    """Trees that fit the classes y by softmax loss, each tree by gradients and second derivatives.

    Histograms of numbers are over their bins; those of flags over the rows that
    have them, so a thousand rare tokens cost what their rows cost. Each round
    looks at a share of the rows, drawn from a fixed seed.
    """
    edges = np.stack([np.quantile(c, np.arange(1, bins) / bins) for c in numbers.T]) if len(y) else np.zeros((numbers.shape[1], bins - 1))
    prior = np.log((np.bincount(y, minlength=classes) + 1.0) / (len(y) + classes))
    inner, n, f, k = (1 << depth) - 1, len(y), numbers.shape[1], flags.shape[1]
    trees = Trees(edges, *(np.zeros((rounds, classes, m), t) for m, t in ((inner, np.int64), (inner, np.uint8), (inner + 1, float))), prior)
    x = trees.bins(numbers)
    wide_x = np.concatenate([x, flags.view(np.uint8)], 1)
    row_of, column_of = np.nonzero(flags)
    score, draw = np.tile(prior, (n, 1)), np.random.default_rng(0)
    for t in range(rounds):
        p = np.exp(log_softmax(score))
        k_rows = np.flatnonzero(draw.random(n) < share)
        m = len(k_rows)
        number_of = np.full(n, -1)
        number_of[k_rows] = np.arange(m)
        held = number_of[row_of] >= 0
        row, column = number_of[row_of[held]], column_of[held]
        x_at, seen = x[k_rows] + np.arange(f) * bins, wide_x[k_rows]
        for c in range(classes):
            g, h = (p[:, c] - (y == c))[k_rows], (p[:, c] * (1 - p[:, c]))[k_rows]
            place = np.zeros(m, np.int64)
            for level in range(depth):
                first, wide = (1 << level) - 1, 1 << level
                node = place - first
                key = (node[:, None] * (f * bins) + x_at).ravel()
                flag_key = node[row] * k + column
                total, left = [], []
                for v in (g, h, None):
                    each = None if v is None else np.repeat(v, f)
                    total.append(np.bincount(node, v, wide))
                    below = np.bincount(key, each, wide * f * bins).reshape(wide, f, bins).cumsum(2)[:, :, :-1].reshape(wide, -1)
                    without = total[-1][:, None] - np.bincount(flag_key, None if v is None else v[row], wide * k).reshape(wide, k)
                    left.append(np.concatenate([below, without], 1))
                right = [s[:, None] - a for a, s in zip(left, total, strict=True)]
                gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - (total[0] ** 2 / (total[1] + ridge))[:, None]
                gain[(left[2] < least) | (right[2] < least)] = 0
                best = gain.argmax(1)
                number = best < f * (bins - 1)
                dull = gain[np.arange(wide), best] <= 1e-9
                trees.feature[t, c, first : first + wide] = np.where(dull, 0, np.where(number, best // (bins - 1), f + best - f * (bins - 1)))
                trees.bound[t, c, first : first + wide] = np.where(dull, 255, np.where(number, best % (bins - 1), 0))
                place = trees.step(t, c, place, seen)
            node = place - inner
            trees.leaf[t, c] = -rate * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + ridge)
            place = np.zeros(n, np.int64)
            for _ in range(depth):
                place = trees.step(t, c, place, wide_x)
            score[:, c] += trees.leaf[t, c][place - inner]
    return trees
