"""Trees that prefer recent waves, fitted on bounded samples: no engine has them built in.

Among splits whose gain lies within a threshold of the best one, a split on the most recent wave is taken. Fitted on at most
``max_rows`` rows chosen by a hash (a documented bound), applied to all rows in vectorised batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np


def _impurity(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(-1, keepdims=True)
    p = np.divide(counts, n, out=np.zeros_like(counts, dtype=float), where=n > 0)
    return 1 - (p * p).sum(-1)


@dataclass
class LexicoTree:
    """Gini tree with the lexicographic choice; ``recency`` holds each feature's wave, -1 for static features."""

    n_classes: int
    recency: Sequence[int]
    threshold: float = 0.0015
    max_depth: int = 8
    min_leaf: int = 2
    max_features: int | None = None
    random_split: bool = False
    seed: int = 0
    nodes: list[tuple] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> LexicoTree:
        self.rng = np.random.default_rng(self.seed)
        self.nodes = []
        w = np.ones(len(y)) if weight is None else weight
        self._grow(x, y, w, np.arange(len(y)), 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray, depth: int) -> int:
        counts = np.bincount(y[rows], w[rows], self.n_classes)
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, counts / max(counts.sum(), 1e-12)))
        if depth >= self.max_depth or len(rows) < 2 * self.min_leaf or (counts > 0).sum() < 2:
            return at
        best = self._split(x, y, w, rows, counts)
        if best is None:
            return at
        f, cut = best
        left = rows[x[rows, f] <= cut]
        right = rows[x[rows, f] > cut]
        a = self._grow(x, y, w, left, depth + 1)
        b = self._grow(x, y, w, right, depth + 1)
        self.nodes[at] = (f, cut, a, b, self.nodes[at][4])
        return at

    def _split(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[int, float] | None:
        total, parent = counts.sum(), float(_impurity(counts))
        features = np.arange(x.shape[1])
        if self.max_features and self.max_features < len(features):
            features = self.rng.choice(features, self.max_features, replace=False)
        found = []
        hot = np.zeros((len(rows), self.n_classes))
        hot[np.arange(len(rows)), y[rows]] = w[rows]
        for f in features:
            order = np.argsort(x[rows, f], kind="stable")
            v = x[rows[order], f]
            left = np.cumsum(hot[order], 0)[:-1]
            ok = (v[1:] > v[:-1]) & (np.arange(1, len(v)) >= self.min_leaf) & (len(v) - np.arange(1, len(v)) >= self.min_leaf)
            if not ok.any():
                continue
            gain = parent - (left.sum(1) * _impurity(left) + (total - left.sum(1)) * _impurity(counts - left)) / max(total, 1e-12)
            gain[~ok] = -np.inf
            k = int(self.rng.choice(np.flatnonzero(ok))) if self.random_split else int(np.argmax(gain))
            if gain[k] > 1e-9:
                found.append((gain[k], int(f), (v[k] + v[k + 1]) / 2))
        if not found:
            return None
        best = max(g for g, _, _ in found)
        near = [x for x in found if x[0] >= best - self.threshold]
        _, f, cut = max(near, key=lambda s: (self.recency[s[1]], s[0], -s[1]))
        return f, cut

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        feature = np.array([n[0] for n in self.nodes])
        cut = np.array([n[1] for n in self.nodes])
        kids = np.array([(n[2], n[3]) for n in self.nodes])
        leaf = np.array([n[4] for n in self.nodes])
        while (feature[at] >= 0).any():
            go = feature[at] >= 0
            r = np.flatnonzero(go)
            at[r] = kids[at[r], (x[r, feature[at[r]]] > cut[at[r]]).astype(int)]
        return leaf[at]


@dataclass
class Forest:
    trees: list[LexicoTree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], 0)


def fit_forest(x: np.ndarray, y: np.ndarray, n_classes: int, recency: Sequence[int], *, n: int = 40, seed: int = 0, random_split: bool = False, max_depth: int = 8) -> Forest:
    rng, trees = np.random.default_rng(seed), []
    m = max(1, int(np.sqrt(x.shape[1])))
    for k in range(n):
        rows = np.arange(len(y)) if random_split else rng.integers(0, len(y), len(y))
        trees.append(LexicoTree(n_classes, recency, max_features=m, seed=seed + k, max_depth=max_depth, random_split=random_split).fit(x[rows], y[rows]))
    return Forest(trees)


@dataclass
class Boosted:
    """Gradient boosting of small trees on class residuals, one score a class."""

    rounds: list[list]
    rate: float
    start: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for k, (tree, value) in enumerate(trees):
                z[:, k] += self.rate * value[_leaf(tree, x)]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _leaf(tree: LexicoTree, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    feature, cut, kids = np.array([n[0] for n in tree.nodes]), np.array([n[1] for n in tree.nodes]), np.array([(n[2], n[3]) for n in tree.nodes])
    while (feature[at] >= 0).any():
        r = np.flatnonzero(feature[at] >= 0)
        at[r] = kids[at[r], (x[r, feature[at[r]]] > cut[at[r]]).astype(int)]
    return at


def fit_boosted(x: np.ndarray, y: np.ndarray, n_classes: int, recency: Sequence[int], *, n: int = 20, rate: float = 0.3, depth: int = 3, seed: int = 0) -> Boosted:
    prior = np.log(np.bincount(y, minlength=n_classes) / len(y) + 1e-9)
    z, rounds = np.tile(prior, (len(y), 1)), []
    for i in range(n):
        e = np.exp(z - z.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        trees = []
        for k in range(n_classes):
            r = (y == k) - p[:, k]
            # the sign of the residual is what a tree separates, its size the weight
            tree = LexicoTree(2, recency, max_depth=depth, seed=seed + i).fit(x, (r > 0).astype(int), np.abs(r) + 1e-9)
            leaf = _leaf(tree, x)
            top = np.bincount(leaf, r, len(tree.nodes))
            under = np.bincount(leaf, p[:, k] * (1 - p[:, k]), len(tree.nodes))
            value = top / (under + 1e-3)
            trees.append((tree, value))
            z[:, k] += rate * value[leaf]
        rounds.append(trees)
    return Boosted(rounds, rate, prior)


@dataclass
class Nested:
    """An outer tree whose features are the class scores of one inner tree per feature group."""

    inner: list[tuple[list[int], LexicoTree]]
    outer: LexicoTree

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([t.predict(x[:, cols]) for cols, t in self.inner], 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.outer.predict(self.features(x))


def fit_nested(x: np.ndarray, y: np.ndarray, n_classes: int, recency: Sequence[int], groups: Sequence[Sequence[int]], *, seed: int = 0) -> Nested:
    static = [i for i in range(x.shape[1]) if not any(i in g for g in groups)]
    parts = [list(g) for g in groups] + ([static] if static else [])
    inner = [(cols, LexicoTree(n_classes, [recency[c] for c in cols], max_depth=3, seed=seed).fit(x[:, cols], y)) for cols in parts]
    model = Nested(inner, LexicoTree(n_classes, [], max_depth=5, seed=seed))
    z = model.features(x)
    model.outer = LexicoTree(n_classes, [0] * z.shape[1], max_depth=5, seed=seed).fit(z, y)
    return model


@dataclass
class Deep:
    """Layers of forests, each fed the features and the last layer's class scores."""

    layers: list[list[Forest]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        scores = None
        for layer in self.layers:
            own = x if scores is None else np.concatenate([x, scores], 1)
            each = [f.predict(own) for f in layer]
            scores = np.concatenate(each, 1)
        return np.mean(each, 0)


def fit_deep(x: np.ndarray, y: np.ndarray, n_classes: int, recency: Sequence[int], *, layers: int = 2, seed: int = 0) -> Deep:
    out, own = [], x
    for k in range(layers):
        r = [*recency, *[-1] * (own.shape[1] - x.shape[1])]
        layer = [fit_forest(own, y, n_classes, r, n=15, seed=seed + 100 * k), fit_forest(own, y, n_classes, r, n=15, seed=seed + 100 * k + 50, random_split=True)]
        out.append(layer)
        own = np.concatenate([x, *(f.predict(own) for f in layer)], 1)
    return Deep(out)
