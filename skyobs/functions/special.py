"""Special functions on numpy arrays, and seeds that don't depend on partitioning."""

from __future__ import annotations

import hashlib
import math

import numpy as np


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    lbeta = np.vectorize(math.lgamma, otypes=[float])
    inside = (z > 0) & (z < 1)
    safe = np.where(inside, z, 0.5)
    front = np.exp(p * np.log(safe) + q * np.log1p(-safe) - (lbeta(p) + lbeta(q) - lbeta(p + q))) / p
    value = np.where(inside, front * h, np.where(z >= 1, 1.0, 0.0))
    return np.where(flip, 1 - value, value)


def beta_tail(f: np.ndarray, kappa: float, above: float = 0.9) -> np.ndarray:
    """P(Beta((1-f) kappa, f kappa) > above), both parameters floored at 1e-6."""
    f = np.asarray(f, float)
    return 1 - betainc(np.maximum(1e-6, (1 - f) * kappa), np.maximum(1e-6, f * kappa), np.full(f.shape, above))


def chi2_1_tail(x: float) -> float:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the incomplete beta function."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        below = 1 - 0.5 * float(betainc(df / 2, 0.5, df / (df + mid * mid)))
        low, high = (mid, high) if below < p else (low, mid)
    return (low + high) / 2


def rng(seed: int, *key) -> np.random.Generator:
    """A generator for a key: the same whichever task runs it."""
    digest = hashlib.sha256(repr((seed, *key)).encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:8], "little"))
