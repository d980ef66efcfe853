"""Small boosted trees and a lasso logistic fit, for bounded training samples on the driver.

A tree is a list of nodes, the root first: ``(feature, threshold, left, right)``
with ``left`` for values <= threshold, or ``(value,)`` for a leaf.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = list[tuple]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))
        return values
    return (values[:-1] + values[1:]) / 2


def _grow(code: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: int, l2: float, tree: Tree) -> int:
    at = len(tree)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    tree.append((float(-total_g / (total_h + l2)),))
    if depth == 0 or len(rows) < 2 * least:
        return at
    best = (1e-6, -1, -1)
    base = total_g**2 / (total_h + l2)
    for f, c in enumerate(cuts):
        if len(c) == 0:
            continue
        k = code[rows, f]
        n = np.bincount(k, minlength=len(c) + 1).cumsum()[:-1]
        left_g = np.bincount(k, g[rows], len(c) + 1).cumsum()[:-1]
        left_h = np.bincount(k, h[rows], len(c) + 1).cumsum()[:-1]
        gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2) - base
        gain[(n < least) | (len(rows) - n < least)] = -1
        if gain.max() > best[0]:
            best = (float(gain.max()), f, int(gain.argmax()))
    if best[1] < 0:
        return at
    _, f, cut = best
    goes = code[rows, f] <= cut
    left = _grow(code, cuts, g, h, rows[goes], depth - 1, least, l2, tree)
    right = _grow(code, cuts, g, h, rows[~goes], depth - 1, least, l2, tree)
    tree[at] = (f, float(cuts[f][cut]), left, right)
    return at


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 64, least: int = 5, l2: float = 1.0) -> tuple[float, list[Tree]]:
    """The prior's log odds and the trees whose (already shrunk) leaves are added to it."""
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
    if len(y) == 0 or y.min() == y.max():
        return prior, []
    cuts = [_cuts(x[:, f], bins) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z, out = np.full(len(y), prior), []
    for _ in range(trees):
        p = sigmoid(z)
        tree: Tree = []
        _grow(code, cuts, p - y, p * (1 - p), np.arange(len(y)), depth, least, l2, tree)
        tree = [(n[0] * rate,) if len(n) == 1 else n for n in tree]
        if len(tree) == 1:
            break
        z += apply_tree(tree, x)
        out.append(tree)
    return prior, out


def apply_tree(tree: Tree, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))

    def walk(at: int, rows: np.ndarray) -> None:
        node = tree[at]
        if len(node) == 1:
            out[rows] = node[0]
            return
        goes = x[rows, node[0]] <= node[1]
        walk(node[2], rows[goes])
        walk(node[3], rows[~goes])

    walk(0, np.arange(len(x)))
    return out


def tree_column(tree: Tree, names: list[str], at: int = 0) -> Column:
    """The tree as nested ``when``."""
    node = tree[at]
    if len(node) == 1:
        return F.lit(float(node[0]))
    return F.when(F.col(names[node[0]]) <= F.lit(node[1]), tree_column(tree, names, node[2])).otherwise(tree_column(tree, names, node[3]))


Rule = tuple[tuple[int, bool, float], ...]


def rules_of(trees: list[Tree]) -> list[Rule]:
    """Every path from a root to a node below it, as a conjunction of (feature, at most, threshold)."""
    found: dict[Rule, None] = {}

    def walk(tree: Tree, at: int, path: tuple) -> None:
        if path:
            found[tuple(sorted(path))] = None
        node = tree[at]
        if len(node) > 1:
            walk(tree, node[2], (*path, (node[0], True, node[1])))
            walk(tree, node[3], (*path, (node[0], False, node[1])))

    for tree in trees:
        walk(tree, 0, ())
    return list(found)


def rule_matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for f, at_most, t in rule:
            out[:, k] *= (x[:, f] <= t) if at_most else (x[:, f] > t)
    return out


def fit_lasso(r: np.ndarray, y: np.ndarray, weight: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1 logistic regression, by accelerated proximal gradient."""
    n, m = r.shape
    w, b = np.zeros(m), 0.0
    if n == 0 or y.min() == y.max():
        return (0.0 if n == 0 else float(np.log((y.sum() + 1) / (n - y.sum() + 1)))), w
    v, c, t = w, b, 1.0
    step = 4 / (np.linalg.norm(np.column_stack([r, np.ones(n)]), 2) ** 2 / n)
    for _ in range(steps):
        e = (sigmoid(r @ v + c) - y) / n
        new = v - step * (r.T @ e)
        new = np.sign(new) * np.maximum(np.abs(new) - step * weight, 0)
        new_b = c - step * e.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return float(b), w


def rule_column(rule: Rule, names: list[str]) -> Column:
    out = None
    for f, at_most, t in rule:
        one = F.col(names[f]) <= F.lit(t) if at_most else F.col(names[f]) > F.lit(t)
        out = one if out is None else out & one
    return out
