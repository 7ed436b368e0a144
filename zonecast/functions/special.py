"""Upper tail of the F distribution, for arrays (no scipy here)."""

from __future__ import annotations

from math import lgamma

import numpy as np

_TINY = 1e-300


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = np.ones_like(h)
        for t in (even, odd):
            d = 1.0 + t * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + t / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    log_gamma = np.vectorize(lgamma, otypes=[float])
    out = np.where(x >= 1.0, 1.0, 0.0)
    inside = (x > 0.0) & (x < 1.0)
    if not inside.any():
        return out
    a, b, x = a[inside], b[inside], x[inside]
    swap = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    front = np.exp(
        log_gamma(aa + bb) - log_gamma(aa) - log_gamma(bb)
        + aa * np.log(xx) + bb * np.log1p(-xx)
    )
    part = front * _beta_fraction(aa, bb, xx) / aa
    out[inside] = np.where(swap, 1.0 - part, part)
    return out


def f_sf(f, d1, d2) -> np.ndarray:
    """P(F > f) with d1 and d2 degrees of freedom; NaN where d2 < 1 or f is undefined."""
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (f, d1, d2)))
    out = np.full(f.shape, np.nan)
    good = ~np.isnan(f) & (d2 >= 1)
    x = d2[good] / (d2[good] + d1[good] * np.maximum(f[good], 0.0))
    out[good] = betainc(d2[good] / 2.0, d1[good] / 2.0, x)
    return out
