"""Linear models on sparse rows: hinge loss by dual coordinate descent, and a logistic calibration of their margins."""

from __future__ import annotations

import numpy as np

Row = tuple[np.ndarray, np.ndarray]


def dual_coordinate_descent(rows: list[Row], y: np.ndarray, size: int, cost: float = 1.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights of length size + 1 (the last: bias) minimising |w|^2 / 2 + cost * sum of hinge losses; y in {-1, 1}."""
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            at, v = rows[i]
            gradient = y[i] * (float(w[at] @ v) + w[size]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                w[size] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4 * cost:
            break
    return w


def margins(rows: list[Row], w: np.ndarray) -> np.ndarray:
    return np.array([float(w[at] @ v) + w[-1] for at, v in rows])


def logistic(margin: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a margin + b))) by weighted Newton steps with a slight pull to zero."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - positive)) + 1e-3 * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])
