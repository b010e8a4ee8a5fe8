"""Tail probabilities of test statistics.

They are taken of finished test results, a handful of rows, so plain numeric code
inside a task is enough; everything that grows with the data happens before.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions.normal import normal_cdf_array


def _series(x: float) -> float:
    """What Stirling's formula leaves of log gamma, for large x."""
    return 1.0 / (12.0 * x) - 1.0 / (360.0 * x**3) + 1.0 / (1260.0 * x**5)


def log_beta(a: float, b: float) -> float:
    """Log of the beta function; large arguments go by differences that do not cancel."""
    low, high = min(a, b), max(a, b)
    if high < 1000.0:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    # lgamma(high + low) - lgamma(high)
    grown = low * math.log(high) + (high + low - 0.5) * math.log1p(low / high) - low + _series(high + low) - _series(high)
    return math.lgamma(low) - grown


def beta_lower(x: float, a: float, b: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function.

    ``rest`` is 1 - x where that is known more exactly than x. The fraction converges below the
    mean of the distribution only, so beyond it the other side is taken, of which 1 then has
    more left than can cancel.
    """
    rest = 1.0 - x if rest is None else rest
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    # x > (a + 1) / (a + b + 2), without taking x from 1; a little below, it still converges,
    # and keeps digits that the other side loses where a or b is in the millions
    slack = 4.0 if max(a, b) > 1e6 and min(a, b) < 100.0 and x > rest else 1.0
    if slack * (b + 1.0) * x > (a + 1.0) * rest:
        return 1.0 - _beta_fraction(rest, b, a, x)
    return _beta_fraction(x, a, b, rest)


def _beta_fraction(x: float, a: float, b: float, rest: float) -> float:
    """The continued fraction, followed until it no longer changes."""
    log_x, log_rest = (math.log(x), math.log1p(-x)) if x < rest else (math.log1p(-rest), math.log(rest))
    front = math.exp(a * log_x + b * log_rest - log_beta(a, b)) / a
    whole = lambda v: v if abs(v) > 1e-300 else 1e-300
    c, d = 1.0, 1.0 / whole((1.0 - b * x + a * rest) / (a + 1.0))
    out, m = d, 0
    while True:
        m += 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 / whole(1.0 + step * d)
            c = whole(1.0 + step / c)
            out *= c * d
        if abs(c * d - 1.0) < 4e-16:
            return front * out


def f_upper(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    total = df2 + df1 * f
    return beta_lower(df2 / total, df2 / 2.0, df1 / 2.0, df1 * f / total)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return f_upper(t * t, 1.0, df)


def chi2_upper(x: float, df: int) -> float:
    """P(X > x) for a whole number of degrees of freedom, by its finite sum."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    total = math.erfc(math.sqrt(half)) if df % 2 else 0.0
    k = 0.5 if df % 2 else 0.0
    while k < df / 2.0 - 0.25:
        total += math.exp(k * math.log(half) - half - math.lgamma(k + 1.0))
        k += 1.0
    return min(total, 1.0)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([
        chi2_upper(a, int(b)) if pd.notna(a) and pd.notna(b) and b > 0 else None for a, b in zip(x, df)
    ], dtype="float64")


def _legendre(low: float, high: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    nodes, weights = np.polynomial.legendre.leggauss(n)
    return (high - low) / 2 * nodes + (high + low) / 2, (high - low) / 2 * weights


def _range_lower(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals < w)."""
    z, weight = _legendre(-8.5, 8.5, 160)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inner = np.clip(normal_cdf_array(z) - normal_cdf_array(z - w[:, None]), 0.0, None) ** (k - 1)
    return np.clip(k * (inner * (density * weight)).sum(axis=1), 0.0, 1.0)


def tukey_upper(q: float, k: int, df: float) -> float:
    """P(studentized range of k means > q), integrated over the estimated deviation."""
    if q <= 0:
        return 1.0
    spread = 10.0 / math.sqrt(2.0 * df)
    e, weight = _legendre(max(1e-12 - 1.0, -spread), spread * (1 if df > 4 else 3), 160)  # deviation less 1
    half, log_s = df / 2.0, np.log1p(e)
    scale = half * math.log(half) - half - math.lgamma(half) if half < 1000.0 else (
        0.5 * math.log(half / (2.0 * math.pi)) - _series(half))
    log_density = math.log(2) + scale + half * (2.0 * log_s - e * (2.0 + e)) - log_s
    upper = (np.exp(log_density) * weight * (1.0 - _range_lower(q * (1.0 + e), k))).sum()
    return float(min(max(upper, 0.0), 1.0))


def tukey_quantile(prob: float, k: int, df: float) -> float:
    """Studentized range that is exceeded with probability ``1 - prob``."""
    low, high = 0.0, 8.0
    while tukey_upper(high, k, df) > 1.0 - prob:
        high *= 2.0
    for _ in range(60):
        middle = (low + high) / 2.0
        low, high = (middle, high) if tukey_upper(middle, k, df) > 1.0 - prob else (low, middle)
    return (low + high) / 2.0
