"""Linear models that are fitted on the driver from small samples."""

from __future__ import annotations

import numpy as np


def svm(gram: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Shares of the rows in the weights of a linear support vector machine (y is -1 or 1).

    Dual coordinate descent over the rows' inner products, one added for the
    bias, in a fixed order, with the costs weighed so that both classes count
    alike.  Weights are ``shares @ x`` and the bias is ``shares.sum()``.
    """
    share = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    upper = cost * len(y) / (2.0 * np.maximum(share, 1))
    alpha, margin, diagonal = np.zeros(len(y)), np.zeros(len(y)), np.maximum(gram.diagonal(), 1e-12).astype(np.float64)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] + (1 - y[i] * margin[i]) / diagonal[i], 0.0), upper[i])
            step = new - alpha[i]
            if step:
                margin += step * y[i] * gram[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return alpha * y


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 400, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression (y is 0 or 1), by gradient descent with momentum, both classes counting alike."""
    each = len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y <= 0).sum()))
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        vw = 0.9 * vw - rate * (x.T @ (each * (p - y)) / len(y) + penalty * w)
        vb = 0.9 * vb - rate * float(np.mean(each * (p - y)))
        w, b = w + vw, b + vb
    return w, b
