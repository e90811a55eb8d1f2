"""How alike two matrices are, beyond sums over their cells."""

from __future__ import annotations

import numpy as np


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Ratio of double-centred distance covariances of the cells."""
    def centred(v):
        d = np.abs(v.reshape(-1)[:, None] - v.reshape(-1))
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    low = np.sqrt((a * a).mean() * (b * b).mean())
    return float((a * b).mean() / low) if low > 0 else 0.0


def rv(x: np.ndarray, y: np.ndarray) -> float:
    a, b = x @ x.T, y @ y.T
    low = np.sqrt(np.trace(a @ a) * np.trace(b @ b))
    return float(np.trace(a @ b) / low) if low > 0 else 0.0
