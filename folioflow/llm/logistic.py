"""Logistic regression on a bounded sample of feature rows, fitted in the driver."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Weights over standardised features; without both classes a constant share."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> None:
        labels = labels.astype(float)
        n, width = features.shape
        self.mean = features.mean(axis=0) if n else np.zeros(width)
        self.scale = features.std(axis=0) if n else np.ones(width)
        self.scale = np.where(self.scale > 1e-12, self.scale, 1.0)
        # A share that can't be told from the labels is a half, drawn towards it when they are few.
        share = (labels.sum() + 0.5) / (n + 1)
        self.weights = np.zeros(width + 1)
        self.weights[-1] = np.log(share / (1 - share))
        if 0 < labels.sum() < n:
            self._fit(self._prepared(features), labels, ridge)

    def _prepared(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -10, 10)
        return np.hstack([z, np.ones((len(z), 1))])

    def _fit(self, x: np.ndarray, y: np.ndarray, ridge: float) -> None:
        penalty = np.full(x.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            gradient = x.T @ (y - p) - penalty * self.weights
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(curve, gradient)
            self.weights += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._prepared(features) @ self.weights, -30, 30)))
