"""Small boosted trees on a bounded table of numbers, and their form as Spark columns.

Fitting runs on the driver over a sample whose size is a parameter of its caller; scoring never does.
A tree is a leaf value, or (feature, threshold, left, right) with left taken where feature <= threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = float | tuple


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds halfway between neighbouring values at about equal counts."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1), method="nearest"))
    return (values[:-1] + values[1:]) / 2


def _grow(codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: int, ridge: float) -> Tree:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, -1, -1)
    if depth and len(rows) >= 2 * least:
        for f, points in enumerate(cuts):
            if not len(points):
                continue
            c = codes[rows, f]
            left_g = np.cumsum(np.bincount(c, g[rows], len(points) + 1))[:-1]
            left_h = np.cumsum(np.bincount(c, h[rows], len(points) + 1))[:-1]
            n = np.cumsum(np.bincount(c, minlength=len(points) + 1))[:-1]
            gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
            gain[(n < least) | (len(rows) - n < least)] = -1
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), f, at)
    if best[1] < 0:
        return float(-total_g / (total_h + ridge))
    _, f, at = best
    goes = codes[rows, f] <= at
    sides = [_grow(codes, cuts, g, h, rows[m], depth - 1, least, ridge) for m in (goes, ~goes)]
    return (f, float(cuts[f][at]), *sides)


def predict(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, left, right = tree
    out, goes = np.empty(len(x)), x[:, f] <= t
    out[goes], out[~goes] = predict(left, x[goes]), predict(right, x[~goes])
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 10, ridge: float = 1.0) -> tuple[float, list[Tree]]:
    """(start, trees) of the log odds of y = 1."""
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    cuts = [cut_points(x[:, f], bins) for f in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    score, trees, rows = np.full(len(y), start), [], np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _scaled(_grow(codes, cuts, p - y, np.maximum(p * (1 - p), 1e-6), rows, depth, least, ridge), rate)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        score += predict(tree, x)
    return start, trees


def _scaled(tree: Tree, by: float) -> Tree:
    return (*tree[:2], _scaled(tree[2], by), _scaled(tree[3], by)) if isinstance(tree, tuple) else tree * by


def column(tree: Tree, features: list[Column]) -> Column:
    """The tree's value as nested conditions."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, t, left, right = tree
    return F.when(features[f] <= t, column(left, features)).otherwise(column(right, features))


def paths(tree: Tree, so_far: tuple = ()) -> list[tuple]:
    """The conjunctions on the way to every node but the root: tuples of (feature, is_at_most, threshold)."""
    if not isinstance(tree, tuple):
        return []
    f, t, left, right = tree
    out = []
    for side, at_most in ((left, True), (right, False)):
        here = (*so_far, (f, at_most, t))
        out += [here, *paths(side, here)]
    return out
