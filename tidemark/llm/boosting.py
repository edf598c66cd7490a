"""Gradient-boosted trees for several classes, on binned features, in numpy.

Each round fits one tree per class to the softmax loss by second-order gains. Trees have
one fixed depth, so a forest is three arrays and scoring needs no branches.
"""

from __future__ import annotations

from dataclasses import dataclass

ROUNDS, DEPTH, RATE = 30, 4, 0.25
BINS = 32
SHRINK = 2.0  # added to second derivatives


@dataclass(frozen=True)
class Forest:
    feature: object  # (trees, inner nodes), by level
    bound: object  # (trees, inner nodes): go right if the value is greater
    leaf: object  # (trees, leaves)
    start: object  # score of each class before the first tree

    def log_odds(self, x):
        """Log probabilities, one row per row of ``x``; tree t belongs to class t mod classes."""
        import numpy as np

        trees, inner = self.feature.shape
        classes = len(self.start)
        scores = np.tile(self.start, (len(x), 1))
        rows = np.arange(len(x))
        for t in range(trees):
            at = np.zeros(len(x), np.int64)
            while True:
                # Children of node k are 2k + 1 and 2k + 2.
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.bound[t, at])
                if not len(at) or at[0] >= inner:
                    break
            scores[:, t % classes] += self.leaf[t, at - inner]
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def _tree(codes, grad, hess, bins: int, depth: int, shrink: float):
    """(features, cuts, leaf values, leaf of each row) of one tree on binned rows."""
    import numpy as np

    n, width = codes.shape
    base = codes + np.arange(width, dtype=np.int64) * bins
    at = np.zeros(n, np.int64)  # place among the nodes of the level
    features, cuts = [], []
    for level in range(depth):
        nodes = 1 << level
        key = (base + at[:, None] * (width * bins)).ravel()
        shape = (nodes, width, bins)
        g = np.bincount(key, np.repeat(grad, width), nodes * width * bins).reshape(shape).cumsum(axis=2)
        h = np.bincount(key, np.repeat(hess, width), nodes * width * bins).reshape(shape).cumsum(axis=2)
        all_g, all_h = g[:, :, -1:], h[:, :, -1:]
        gain = g**2 / (h + shrink) + (all_g - g) ** 2 / (all_h - h + shrink)
        best = gain.reshape(nodes, -1).argmax(axis=1)
        features.append(best // bins)
        cuts.append(best % bins)
        at = 2 * at + (codes[np.arange(n), features[-1][at]] > cuts[-1][at])
    leaves = 1 << depth
    value = -np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + shrink)
    return np.concatenate(features), np.concatenate(cuts), value, at


def fit(x, y, classes: int, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, weight=None) -> Forest:
    """Forest for rows ``x`` (floats) of classes ``y``; the same rows give the same forest."""
    import numpy as np

    n, width = x.shape
    weight = np.ones(n) if weight is None else weight
    bounds = np.full((width, BINS), np.inf)
    codes = np.zeros((n, width), np.int64)
    for f in range(width):
        values = np.unique(x[:, f])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        middles = values[:-1] if len(values) < 2 else (values[:-1] + values[1:]) / 2
        bounds[f, : len(middles)] = middles
        codes[:, f] = np.searchsorted(middles, x[:, f])
    share = np.bincount(y, weight, classes) + 1.0
    start = np.log(share / share.sum())
    scores = np.tile(start, (n, 1))
    features, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for c in range(classes):
            grad, hess = (p[:, c] - (y == c)) * weight, p[:, c] * (1 - p[:, c]) * weight
            f, cut, value, at = _tree(codes, grad, hess, BINS, depth, SHRINK)
            features.append(f)
            cuts.append(bounds[f, cut])
            leaves.append(rate * value)
            scores[:, c] += rate * value[at]
    return Forest(np.array(features), np.array(cuts), np.array(leaves), start)
