"""Tail probabilities of the chi-squared, F and beta distributions, on the driver and as vectorised column functions.

Series and continued fractions after their textbook forms; small tails come from the complement, not from one minus a number near one.
"""

from __future__ import annotations

from math import exp, inf, isnan, lgamma, log, log1p, nan
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()
_EPS, _TINY, _STEPS = 1e-16, 1e-300, 10_000


def gamma_q(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if isnan(a) or isnan(x) or a <= 0 or x < 0:
        return nan
    if x == 0:
        return 1.0
    if x == inf:
        return 0.0
    scale = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for i in range(1, _STEPS):
            term *= x / (a + i)
            total += term
            if term < total * _EPS:
                break
        return 1 - scale * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, _STEPS):
        n = -i * (i - a)
        b += 2
        d = 1 / _away(n * d + b)
        c = _away(b + n / c)
        h *= d * c
        if abs(d * c - 1) < _EPS * 4:
            break
    return scale * h


def _away(v: float) -> float:
    return v if abs(v) > _TINY else _TINY


def beta_i(a: float, b: float, x: float) -> float:
    """The lower regularised incomplete beta function."""
    if isnan(x) or a <= 0 or b <= 0:
        return nan
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    scale = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    return scale * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - scale * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / _away(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, _STEPS):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _away(1 + n * d)
            c = _away(1 + n / c)
            h *= d * c
        if abs(d * c - 1) < _EPS * 4:
            break
    return h


def beta_quantile(a: float, b: float, p: float) -> float:
    """The p-quantile of Beta(a, b), by bisection on the distribution function."""
    if not 0 <= p <= 1 or a <= 0 or b <= 0:
        return nan
    lo, hi = 0.0, 1.0
    while True:
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            return mid
        lo, hi = (mid, hi) if beta_i(a, b, mid) < p else (lo, mid)


def chi2_tail(x: float, dof: float) -> float:
    return gamma_q(dof / 2, x / 2) if dof and dof > 0 else nan


def f_tail(f: float, d1: float, d2: float) -> float:
    if isnan(f) or not d1 or not d2 or d1 <= 0 or d2 <= 0:
        return nan
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f != inf else 0.0


def beta_binomial_interval(successes: float, trials: float, *, level: float = 0.95, alpha: float = 1.0, beta: float = 1.0) -> tuple[float, float]:
    """The central credible interval of a rate under a Beta(alpha, beta) prior; NaNs without trials."""
    if trials <= 0:
        return nan, nan
    a, b = successes + alpha, trials - successes + beta
    return beta_quantile(a, b, (1 - level) / 2), beta_quantile(a, b, (1 + level) / 2)


def _nulls(values: list[float]) -> pd.Series:
    return pd.Series([None if isnan(v) else v for v in values], dtype="float64")


def chi2_p(x: Column | str, dof: Column | str) -> Column:
    """Upper tail as a column; NULL where it is not defined. Meant for results of one row per test."""

    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return _nulls([chi2_tail(x, d) for x, d in zip(a, b)])

    return f(x, dof)


def f_p(x: Column | str, d1: Column | str, d2: Column | str) -> Column:
    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _nulls([f_tail(x, p, q) for x, p, q in zip(a, b, c)])

    return f(x, d1, d2)


def credible(successes: Column | str, trials: Column | str, level: float = 0.95, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """struct(lo, hi) of beta_binomial_interval as a column."""

    @F.pandas_udf("lo double, hi double")
    def f(s: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([beta_binomial_interval(a, b, level=level, alpha=alpha, beta=beta) for a, b in zip(s, n)], columns=["lo", "hi"])

    return f(successes, trials)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function of a column."""

    @F.pandas_udf("double")
    def f(v: pd.Series) -> pd.Series:
        return v.map(_NORMAL.cdf, na_action="ignore")

    return f(x)


def normal_quantile(p: Column) -> Column:
    """Its inverse; infinite at 0 and 1, NULL outside."""

    @F.pandas_udf("double")
    def f(v: pd.Series) -> pd.Series:
        return v.map(lambda q: None if not 0 <= q <= 1 else -inf if q == 0 else inf if q == 1 else _NORMAL.inv_cdf(q), na_action="ignore").astype("float64")

    return f(p)
