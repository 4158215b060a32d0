"""Small gradient-boosted trees: trained with numpy on the driver, scored as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """A leaf has ``value``; an inner node sends ``feature <= threshold`` to ``low``."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    low: "Tree | None" = None
    high: "Tree | None" = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.threshold, self.low.predict(x), self.high.predict(x))

    def column(self, features: list[Column]) -> Column:
        if self.feature < 0:
            return F.lit(float(self.value))
        return F.when(features[self.feature] <= F.lit(float(self.threshold)), self.low.column(features)).otherwise(self.high.column(features))


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, penalty: float) -> Tree:
    total_g, total_h = gradient.sum(), hessian.sum()
    best = (1e-6, -1, 0.0)
    for f in range(x.shape[1]) if depth else ():
        order = np.argsort(x[:, f], kind="stable")
        v, g, h = x[order, f], np.cumsum(gradient[order]), np.cumsum(hessian[order])
        at = np.flatnonzero(v[1:] > v[:-1])  # the last row of the lower side
        if not len(at):
            continue
        gain = g[at] ** 2 / (h[at] + penalty) + (total_g - g[at]) ** 2 / (total_h - h[at] + penalty) - total_g**2 / (total_h + penalty)
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), f, float(v[at[i]]))
    if best[1] < 0:
        return Tree(value=float(-total_g / (total_h + penalty)))
    low = x[:, best[1]] <= best[2]
    return Tree(
        0.0, best[1], best[2], _grow(x[low], gradient[low], hessian[low], depth - 1, penalty), _grow(x[~low], gradient[~low], hessian[~low], depth - 1, penalty)
    )


def train(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, rate: float = 0.4, penalty: float = 1.0) -> list[Tree]:
    """Boosted trees for the log-odds of ``y`` (0 or 1), by second-order steps."""
    score, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, p - y, p * (1 - p), depth, penalty)
        tree = _scaled(tree, rate)
        out.append(tree)
        score += tree.predict(x)
    return out


def _scaled(tree: Tree, rate: float) -> Tree:
    if tree.feature < 0:
        return Tree(value=tree.value * rate)
    return Tree(0.0, tree.feature, tree.threshold, _scaled(tree.low, rate), _scaled(tree.high, rate))


def log_odds(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return sum((t.predict(x) for t in trees), np.zeros(len(x)))


def log_odds_column(trees: list[Tree], features: list[Column]) -> Column:
    total = F.lit(0.0)
    for t in trees:
        total = total + t.column(features)
    return total


def threshold_for_precision(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The smallest score from which on the held-out rows have at least ``precision`` positives,
    midway to the next lower score; infinite if there is none."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    ok = (hit >= precision * np.arange(1, len(s) + 1)) & np.r_[s[1:] < s[:-1], True]
    if not ok.any():
        return float("inf")
    last = int(np.flatnonzero(ok)[-1])
    below = s[last + 1] if last + 1 < len(s) else s[last] - 1.0
    return float((s[last] + below) / 2)
