"""Logistic regression for the small models that are fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30, toward: tuple[float, ...] = ()) -> np.ndarray:
    """Weights, the intercept last, by Newton's method; the intercept alone if there is one class, 0 without rows.

    The penalty draws the weights to `toward` (by default 0), which is also what they are if rows don't tell.
    """
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    w[: len(toward)] = toward
    goal = w.copy()
    if len(y) == 0:
        return w
    if y.min() == y.max():
        w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w[-1] = np.log(y.mean() / (1 - y.mean()))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (penalty * (w - goal) ** 2).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (y - p) - penalty * (w - goal)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), gradient)
        size = 1.0
        while (then := loss(w + size * step)) > now and size > 1e-6:  # a step that goes too far is halved
            size /= 2
        if then > now:
            break
        w, now, moved = w + size * step, then, now - then
        if moved < 1e-9 * max(1.0, abs(now)):
            break
    return w
