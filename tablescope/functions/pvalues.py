"""Two-sided p-values of correlation coefficients; their frames have one row per pair of columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(tiny, 1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, 1_000_000):  # about the root of a steps are needed
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / (1.0 + term * d or tiny)
            c = 1.0 + term / c or tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _log_gamma_step(a: float) -> float:
    """log(gamma(a + 1/2) / gamma(a)) without the difference of two large numbers."""
    shift = 0.0
    while a < 20.0:
        shift += math.log(a / (a + 0.5))
        a += 1.0
    return shift + 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5) + 17 / (14336 * a**7)


def _incomplete_beta(a: float, x: float) -> float:
    """Regularised incomplete beta function of (a, 1/2) at x."""
    b = 0.5
    if x <= 0.0 or x >= 1.0:
        return min(1.0, max(0.0, x))
    front = math.exp(_log_gamma_step(a) - 0.5 * math.log(math.pi) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p(r: float, n: int) -> float:
    """P-value of a correlation of ``n`` pairs under Student's t with n - 2 degrees of freedom."""
    df = n - 2
    if df < 1 or math.isnan(r):
        return math.nan
    rest = 1.0 - r * r
    if rest <= 0.0:
        return 0.0
    return _incomplete_beta(df / 2.0, rest)


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else correlation_p(a, int(b)) for a, b in zip(r, n, strict=True)])


@F.pandas_udf(T.DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else math.erfc(x / math.sqrt(2.0)) for x in z])
