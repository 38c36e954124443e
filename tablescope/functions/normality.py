"""Shapiro-Wilk test of one small sample (Royston 1995, algorithm AS R94), for use inside a task."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

# Royston's published polynomial coefficients, constant term first.
_A_LAST = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_A_NEXT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_SMALL_GAMMA = [-2.273, 0.459]
_SMALL_MEAN = [0.5440, -0.39978, 0.025054, -6.714e-4]
_SMALL_LOG_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
_LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
_LARGE_LOG_SD = [-0.4803, -0.082676, 0.0030302]


def _poly(coefficients: list[float], x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


def _weights(n: int) -> np.ndarray:
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    length, u = float(m @ m), 1.0 / math.sqrt(n)
    a = m.copy()
    a[-1] = _poly(_A_LAST, u) + m[-1] / math.sqrt(length)
    if n > 5:
        a[-2] = _poly(_A_NEXT, u) + m[-2] / math.sqrt(length)
        rest = (length - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
        a[2:-2] = m[2:-2] / math.sqrt(rest)
        a[1] = -a[-2]
    else:
        rest = (length - 2 * m[-1] ** 2) / (1 - 2 * a[-1] ** 2)
        a[1:-1] = m[1:-1] / math.sqrt(rest)
    a[0] = -a[-1]
    return a


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """(W, p) for 3 to 5,000 values that are not all equal."""
    x = np.sort(np.asarray(values, dtype="float64"))
    n = len(x)
    centred = x - x.mean()
    w = min(1.0, float((_weights(n) @ x) ** 2 / (centred @ centred)))
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, p)
    if w >= 1.0:
        return w, 1.0
    y = math.log(1.0 - w)
    if n <= 11:
        gamma = _poly(_SMALL_GAMMA, n)
        if y >= gamma:
            return w, 0.0
        y = -math.log(gamma - y)
        mean, sd = _poly(_SMALL_MEAN, n), math.exp(_poly(_SMALL_LOG_SD, n))
    else:
        size = math.log(n)
        mean, sd = _poly(_LARGE_MEAN, size), math.exp(_poly(_LARGE_LOG_SD, size))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2.0))
