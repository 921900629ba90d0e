"""Rotation of factor patterns: varimax, quartimax, equimax, promax.  Patterns are small and stay on the driver."""

from __future__ import annotations

import numpy as np


def orthomax(pattern: np.ndarray, gamma: float = 1.0, rounds: int = 500, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """The rotated pattern and the rotation that maximises the orthomax criterion."""
    a = np.asarray(pattern, float)
    p, k = a.shape
    turn, last = np.eye(k), 0.0
    for _ in range(rounds):
        b = a @ turn
        u, s, v = np.linalg.svd(a.T @ (b**3 - gamma / p * b * (b**2).sum(0)))
        turn = u @ v
        if s.sum() < last * (1 + tolerance):
            break
        last = s.sum()
    return a @ turn, turn


def varimax(pattern: np.ndarray) -> np.ndarray:
    return orthomax(pattern, 1.0)[0]


def quartimax(pattern: np.ndarray) -> np.ndarray:
    return orthomax(pattern, 0.0)[0]


def equimax(pattern: np.ndarray) -> np.ndarray:
    return orthomax(pattern, np.asarray(pattern).shape[1] / 2)[0]


def promax(pattern: np.ndarray, power: int = 4) -> np.ndarray:
    """Oblique: least squares onto the varimax pattern's powers, factors scaled to variance 1."""
    own, turn = orthomax(pattern, 1.0)
    target = own * np.abs(own) ** (power - 1)
    map_ = np.linalg.lstsq(own, target, rcond=None)[0]
    scale = np.sqrt(np.diag(np.linalg.inv(map_.T @ map_)))
    return np.asarray(pattern, float) @ turn @ map_ * scale
