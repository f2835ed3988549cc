"""Small gradient-boosted trees that are fitted on the driver on a bounded table and applied as SQL."""

from __future__ import annotations

import math

import numpy as np


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: float) -> tuple:
    """("leaf", value) or (feature, cut, left, right); left is taken where the feature is at most the cut."""
    leaf = ("leaf", float(grad.sum() / (hess.sum() + 1.0)))
    if depth == 0 or hess.sum() < 2 * least:
        return leaf
    best, base = (1e-6, -1, 0.0), grad.sum() ** 2 / (hess.sum() + 1.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, g, h = x[order, j], np.cumsum(grad[order]), np.cumsum(hess[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        gain = g[cut] ** 2 / (h[cut] + 1.0) + (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + 1.0) - base
        gain[(h[cut] < least) | (h[-1] - h[cut] < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float(v[cut[k]] + v[cut[k] + 1]) / 2)
    if best[1] < 0:
        return leaf
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], grad[left], hess[left], depth - 1, least), _grow(x[~left], grad[~left], hess[~left], depth - 1, least))


def _value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if tree[0] == "leaf":
        return np.full(len(x), tree[1])
    left = x[:, tree[0]] <= tree[1]
    return np.where(left, _value(tree[2], x), _value(tree[3], x))


class Boosted:
    """Logistic boosting; `a`, `b` calibrate the margin by Platt's method on rows not used for growing."""

    def __init__(self, trees: list, rate: float, bias: float, a: float = 1.0, b: float = 0.0):
        self.trees, self.rate, self.bias, self.a, self.b = trees, rate, bias, a, b
        self.held = np.empty(0, bool)  # rows of the fitted table that grew no tree

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum((_value(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.margin(x) + self.b)))

    def sql(self, names: list[str]) -> str:
        """The calibrated probability as an SQL expression over the named numeric features."""

        def case(t: tuple) -> str:
            return f"{t[1]:.9f}D" if t[0] == "leaf" else f"CASE WHEN {names[t[0]]} <= {t[1]:.6f}D THEN {case(t[2])} ELSE {case(t[3])} END"

        total = " + ".join(f"({case(t)})" for t in self.trees) or "0.0D"
        return f"1.0D / (1.0D + exp(-({self.a:.9f}D * ({self.bias:.9f}D + {self.rate}D * ({total})) + {self.b:.9f}D)))"


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: float = 1.0, seed: int = 5) -> Boosted:
    """Grown on two thirds of the rows, calibrated on the rest (`held`)."""
    hold = np.random.default_rng(seed).random(len(y)) < 1 / 3
    gx, gy, cx, cy = x[~hold], y[~hold].astype(float), x[hold], y[hold].astype(float)
    share = min(max(gy.mean(), 1e-3), 1 - 1e-3)
    model = Boosted([], rate, math.log(share / (1 - share)))
    model.held = hold
    f = np.full(len(gy), model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        tree = _grow(gx, gy - p, p * (1 - p), depth, least)
        model.trees.append(tree)
        f += rate * _value(tree, gx)
    m = model.margin(cx)
    target = np.where(cy > 0, (cy.sum() + 1) / (cy.sum() + 2), 1 / ((1 - cy).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-(a * m + b)))
        w, d = np.maximum(p * (1 - p), 1e-9), p - target
        h11, h12, h22 = (w * m * m).sum() + 1e-6, (w * m).sum(), w.sum() + 1e-6
        g1, g2 = (d * m).sum(), d.sum()
        det = h11 * h22 - h12 * h12
        a, b = a - (h22 * g1 - h12 * g2) / det, b - (h11 * g2 - h12 * g1) / det
    model.a, model.b = float(a), float(b)
    return model
