"""Small-sample statistics in numpy, and null-safe ratios as expressions."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction(part: Column, total: Column) -> Column:
    """part / total; null unless total > 0."""
    return F.when(total > 0, F.try_divide(part.cast("double"), total.cast("double")))


def ks_two_sample(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(statistic, asymptotic two-sided p) of two samples."""
    a, b = np.sort(a), np.sort(b)
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0, 1.0
    both = np.concatenate([a, b])
    d = float(np.abs(np.searchsorted(a, both, side="right") / n - np.searchsorted(b, both, side="right") / m).max())
    en = math.sqrt(n * m / (n + m))
    lam = (en + 0.12 + 0.11 / en) * d
    if lam < 0.2:
        return d, 1.0
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * lam) ** 2) for k in range(1, 101))
    return d, min(1.0, max(0.0, p))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of the 2 x 2 table [[a, b], [c, d]]: the weight of all tables no likelier than this one."""
    r, s, n = a + b, a + c, a + b + c + d
    log_c = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    lo, hi = max(0, s - (n - r)), min(r, s)
    logs = np.array([log_c(r, x) + log_c(n - r, s - x) - log_c(n, s) for x in range(lo, hi + 1)])
    here = logs[a - lo]
    return float(min(1.0, np.exp(logs[logs <= here + 1e-7]).sum()))


@lru_cache(maxsize=4096)
def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t, by bisection on the distribution function."""
    if df <= 0:
        return float("nan")
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while _t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(52):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


#: Degrees of freedom up to which `t_quantile_of` has a table; beyond it a series is exact to nine digits.
T_TABLE = 200


def t_quantile_of(df: Column, p: float) -> Column:
    """`t_quantile` as an expression of the degrees of freedom, of any number; null below 1. Beyond the table it is
    the expansion in powers of 1 / df around the normal quantile."""
    table = F.array(*[F.lit(t_quantile(p, d)) for d in range(1, T_TABLE + 1)])
    z = NormalDist().inv_cdf(p)
    terms = t_series(z)
    series = F.lit(z)
    for i, c in enumerate(terms, 1):
        series = series + F.lit(c) / F.pow(df.cast("double"), F.lit(float(i)))
    return F.when(df > T_TABLE, series).when(df >= 1, F.get(table, (F.least(df, F.lit(T_TABLE)) - 1).cast("int")))


def t_series(z: float) -> list[float]:
    """Factors of 1 / df, 1 / df^2, 1 / df^3 in the expansion of Student's quantile around the normal one, z."""
    return [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]


def _t_cdf(t: float, df: int) -> float:
    return 1 - 0.5 * _beta_inc(df / 2, 0.5, df / (df + t * t))


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function, by the power series of its hypergeometric form on the side where that
    converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    log_front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b)
    term = total = 1.0
    k = 0
    while term > 1e-16 * total and k < 100_000:
        term *= (a + b + k) / (a + 1 + k) * x
        total += term
        k += 1
    return math.exp(log_front) * total


def normal_density(x: float, mean: float, sd: float) -> float:
    return math.exp(-((x - mean) ** 2) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi)) if sd > 0 else float("nan")
