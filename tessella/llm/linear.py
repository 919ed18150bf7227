"""Sparse linear classifiers in numpy, shared by language identification and toxicity."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: column numbers, values, and where each row begins (one more entry)."""

    def __init__(self, columns: np.ndarray, values: np.ndarray, begin: np.ndarray):
        self.columns, self.values, self.begin = columns, values, begin

    def __len__(self) -> int:
        return len(self.begin) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.begin)[rows]
        begin = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.begin[rows] - begin[:-1], size) + np.arange(begin[-1])
        return Rows(self.columns[at], self.values[at], begin)

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Rows times weights (columns, classes)."""
        out = np.zeros((len(self), weights.shape[1]))
        row = np.repeat(np.arange(len(self)), np.diff(self.begin))
        for c in range(weights.shape[1]):
            out[:, c] = np.bincount(row, self.values * weights[self.columns, c], len(self))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)
