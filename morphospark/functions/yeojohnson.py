"""Yeo-Johnson power transform (Yeo & Johnson, 2000) as a Spark expression
and as a numpy function for per-partition statistics.

The plain formula loses all digits where the values lie far from zero and close
together: (x+1)^lambda is then one large or tiny factor times numbers near 1.
The ``scaled`` forms keep that factor as a logarithm.  With a = log1p(|x|) and a
fixed centre r of its range, psi(x) = e^(k r) (e^(k (a - r)) - e^(-k r)) / k; the
second term is the same for all rows and drops out of a variance, the first
factor is returned as its logarithm, and expm1 keeps the digits of the rest.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = float(np.spacing(1.0))


def yeo_johnson_col(x: Column, lam: float) -> Column:
    """psi(x, lambda); built-in expression, stays in codegen."""
    if abs(lam) < EPS:
        pos = F.log1p(x)
    else:
        pos = (F.pow(x + 1.0, F.lit(lam)) - 1.0) / F.lit(lam)
    if abs(lam - 2.0) > EPS:
        neg = -(F.pow(-x + 1.0, F.lit(2.0 - lam)) - 1.0) / F.lit(2.0 - lam)
    else:
        neg = -F.log1p(-x)
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_np(x: np.ndarray, lam: float) -> np.ndarray:
    out = np.empty_like(x, dtype="float64")
    pos = x >= 0
    if abs(lam) < EPS:
        out[pos] = np.log1p(x[pos])
    else:
        out[pos] = (np.power(x[pos] + 1.0, lam) - 1.0) / lam
    if abs(lam - 2.0) > EPS:
        out[~pos] = -(np.power(-x[~pos] + 1.0, 2.0 - lam) - 1.0) / (2.0 - lam)
    else:
        out[~pos] = -np.log1p(-x[~pos])
    return out


#: Largest exponent that is taken as it is; larger ones are scaled down by e^(-largest).
PLAIN_EXPONENT = 30.0


def _frame(lam: float, lo: float, hi: float):
    """(k, r, s, t) for values in [lo, hi] of one sign: exponent, centre, scaling, logarithm of the factor."""
    k = lam if lo >= 0 else 2.0 - lam
    a0, a1 = sorted((math.log1p(abs(lo)), math.log1p(abs(hi))))
    r = (a0 + a1) / 2
    reach = abs(k) * (a1 - a0) / 2
    s = reach if reach > PLAIN_EXPONENT else 0.0
    return (0.0, r, 0.0, 0.0) if abs(k) < EPS else (k, r, s, k * r + s)


def _mixed_scaling(lam: float, lo: float, hi: float) -> float:
    reach = max(lam * math.log1p(hi), (2.0 - lam) * math.log1p(-lo), 0.0)
    return reach if reach > PLAIN_EXPONENT else 0.0


def _power_np(a: np.ndarray, k: float, s: float) -> np.ndarray:
    """(e^(k a) - 1) / k, times e^(-s)."""
    if abs(k) < EPS:
        return a * math.exp(-s)
    return np.expm1(k * a) / k if not s else (np.exp(k * a - s) - math.exp(-s)) / k


def scaled_psi_np(x: np.ndarray, lam: float, lo: float, hi: float) -> tuple[np.ndarray, float]:
    """(y, t): psi(x, lam) is e^t y plus a number that is the same for every x in [lo, hi]."""
    a = np.log1p(np.abs(x))
    if lo >= 0 or hi <= 0:
        k, r, s, t = _frame(lam, lo, hi)
        y = _power_np(a - r, k, s)
        return (y if lo >= 0 else -y), t
    s = _mixed_scaling(lam, lo, hi)
    return np.where(x >= 0, _power_np(np.where(x >= 0, a, 0.0), lam, s),
                    -_power_np(np.where(x < 0, a, 0.0), 2.0 - lam, s)), s


def _power_col(a: Column, k: float, s: float) -> Column:
    if abs(k) < EPS:
        return a * F.lit(math.exp(-s))
    return F.expm1(a * F.lit(k)) / F.lit(k) if not s else (F.exp(a * F.lit(k) - F.lit(s)) - F.lit(math.exp(-s))) / F.lit(k)


def scaled_psi_col(x: Column, lam: float, lo: float, hi: float) -> Column:
    """y of ``scaled_psi_np`` as an expression: psi but for a positive factor and a constant."""
    a = F.log1p(F.abs(x))
    if lo >= 0 or hi <= 0:
        k, r, s, _ = _frame(lam, lo, hi)
        y = _power_col(a - F.lit(r), k, s)
        return y if lo >= 0 else -y
    s = _mixed_scaling(lam, lo, hi)
    return F.when(x >= 0, _power_col(a, lam, s)).otherwise(-_power_col(a, 2.0 - lam, s))
