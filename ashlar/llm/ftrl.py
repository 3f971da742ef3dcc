"""Follow-the-regularised-leader (proximal) updates for sparse linear models."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate FTRL-proximal state over ``size`` hashed features and one bias (the last index)."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, index: np.ndarray, weight: np.ndarray, gradient: np.ndarray) -> None:
        """One step: distinct ``index``, their present weights and gradients."""
        before = self.n[index]
        after = before + gradient * gradient
        self.z[index] += gradient - (np.sqrt(after) - np.sqrt(before)) / self.alpha * weight
        self.n[index] = after


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
