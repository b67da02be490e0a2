"""MM12: two-sided Student-t p-value of a correlation, as a pandas UDF.

There is no t distribution in Spark SQL.  The p-value is the regularised
incomplete beta I_{df/(df+t^2)}(df/2, 1/2), evaluated by the Lentz continued
fraction (Numerical Recipes, "betacf").  The UDF runs on one row per fitted
group, so its cost does not grow with the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1.0e-20  # guards r = +-1, as scipy's linregress does
_FPMIN = 1.0e-300
_EPS = 3.0e-16


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _FPMIN else _FPMIN)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _FPMIN else _FPMIN)
        c = 1.0 + aa / c
        c = c if abs(c) > _FPMIN else _FPMIN
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _FPMIN else _FPMIN)
        c = 1.0 + aa / c
        c = c if abs(c) > _FPMIN else _FPMIN
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            return h
    raise ArithmeticError(f"continued fraction did not converge: a={a}, b={b}, x={x}")


def _log_gamma_step(a: float) -> float:
    """log(gamma(a + 1/2) / gamma(a)); for large a by its series, as the two logs would cancel."""
    if a < 100.0:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1.0 / (8.0 * a) + 1.0 / (192.0 * a ** 3) - 1.0 / (640.0 * a ** 5)


#: Degrees of freedom from which the normal tail at a corrected point is used.
MANY = 1.0e5


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|) with df degrees of freedom: I_x(df/2, 1/2) at x = df / (df + t^2).

    y = 1 - x is computed by itself, so that nothing is lost when x is near 1.
    From ``MANY`` degrees on the fraction would cancel; there the first term of
    Hill's expansion (1970) around the normal distribution is exact to 1e-12.
    """
    a, t2 = df / 2.0, t * t
    if df >= MANY:
        w = (df - 0.5) * math.log1p(t2 / df)
        return math.erfc(math.sqrt(w / 2.0) * (1.0 + (w + 3.0) / (48.0 * (df - 0.5) ** 2)))
    x, y = df / (df + t2), t2 / (df + t2)
    if y == 0.0:
        return 1.0
    if x == 0.0:
        return 0.0
    front = math.exp(_log_gamma_step(a) - math.lgamma(0.5) - a * math.log1p(t2 / df) + 0.5 * math.log(y))
    if front == 0.0:  # far out in the tail
        return 0.0
    if x < (a + 1.0) / (a + 2.5):
        return front * _betacf(a, 0.5, x) / a
    return 1.0 - front * _betacf(0.5, a, y) / 0.5


def t_two_sided_p(r: float, n: int, y_constant: bool = False) -> float | None:
    """p of H0: slope = 0 given Pearson r over n points (scipy semantics)."""
    if r is None or n is None or (isinstance(r, float) and math.isnan(r)) or n < 2:
        return None
    if n == 2:
        return 1.0 if y_constant else 0.0
    df = n - 2.0
    t = r * math.sqrt(df / ((1.0 - r + TINY) * (1.0 + r + TINY)))
    return t_tail(t, df)


@F.pandas_udf(T.DoubleType())
def t_pvalue_udf(r: pd.Series, n: pd.Series, y_constant: pd.Series) -> pd.Series:
    out = [t_two_sided_p(None if pd.isna(ri) else float(ri), None if pd.isna(ni) else int(ni),
                         bool(yc) if not pd.isna(yc) else False)
           for ri, ni, yc in zip(r, n, y_constant)]
    return pd.Series(np.array([np.nan if v is None else v for v in out], dtype="float64"))
