"""Upper tail probabilities for already aggregated rows.

Incomplete beta and gamma functions, vectorised over a batch. Up to ``LARGE`` they are
continued fractions (modified Lentz) and series, which need about the root of the
counts in rounds and raise if they don't converge. Beyond it the integrals on both
sides of the argument are taken by quadrature around the peak and divided, so that
the cost stays the same for any count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
#: From this parameter on the integrand is smooth enough for quadrature to the last digits.
LARGE = 3000.0
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(300)
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    # rounds grow with the root of the larger parameter
    for m in range(1, 1000 + int(30 * math.sqrt(float(np.max(np.maximum(np.abs(a), np.abs(b)), initial=1.0))))):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            return h
    raise ArithmeticError("the continued fraction does not converge")


def _share_below(log_density, x: np.ndarray, mode: np.ndarray, sigma: np.ndarray, low: float, high: float) -> np.ndarray:
    """Share of the density that lies below x; 0 or 1 beyond 38 standard deviations from the mode."""
    at = np.clip(x, np.maximum(mode - 38 * sigma, low), np.minimum(mode + 38 * sigma, high))

    def area(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t = (a + b)[:, None] / 2 + (b - a)[:, None] / 2 * _NODES
        return (np.exp(log_density(t)) * _WEIGHTS).sum(axis=1) * (b - a) / 2

    left = area(np.maximum(np.minimum(at, mode) - 14 * sigma, low), at)
    right = area(at, np.minimum(np.maximum(at, mode) + 14 * sigma, high))
    share = left / (left + right)
    return np.where(x < at, 0.0, np.where(x > at, 1.0, share))


def _large_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    mode = (a - 1) / (a + b - 2)
    sigma = np.sqrt(mode * (1 - mode) / (a + b - 2))

    def log_density(t: np.ndarray) -> np.ndarray:
        m, off = mode[:, None], t - mode[:, None]
        with np.errstate(all="ignore"):
            return (a - 1)[:, None] * np.log1p(off / m) + (b - 1)[:, None] * np.log1p(-off / (1 - m))

    return _share_below(log_density, x, mode, sigma, 0.0, 1.0)


def _large_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    mode = a - 1

    def log_density(t: np.ndarray) -> np.ndarray:
        m, off = mode[:, None], t - mode[:, None]
        with np.errstate(all="ignore"):
            return m * np.log1p(off / m) - off

    return _share_below(log_density, x, mode, np.sqrt(mode), 0.0, np.inf)


def regularized_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    big = np.minimum(a, b) > LARGE
    if big.any():
        out = np.empty(a.shape)
        out[big] = _large_beta(a[big], b[big], x[big])
        out[~big] = regularized_beta(a[~big], b[~big], x[~big])
        return out
    if not a.size:
        return np.zeros(a.shape)
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + p * np.log(y) + q * np.log1p(-y))
    part = front * _beta_fraction(p, q, y) / p
    return np.where(flip, 1 - part, part)


def binomial_upper(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """P(X >= k) for X ~ Binomial(n, p)."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    inside = (k > 0) & (k <= n)
    kk, nn = np.where(inside, k, 1.0), np.where(inside, n, 1.0)
    tail = regularized_beta(kk, nn - kk + 1, np.full_like(kk, p))
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0, tail))


def poisson_upper(k: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """P(X >= k) for X ~ Poisson(lam), lam > 0."""
    k, lam = np.broadcast_arrays(np.asarray(k, float), np.asarray(lam, float))
    big = k > LARGE
    if big.any():
        out = np.empty(k.shape)
        out[big] = _large_gamma(k[big], np.maximum(lam[big], 0.0))
        out[~big] = poisson_upper(k[~big], lam[~big])
        return out
    if not k.size:
        return np.zeros(k.shape)
    # so far above k that the other side is below the last digit
    sure = lam > k + 40 * np.sqrt(k + 40) + 800
    a, x = np.maximum(k, 1e-9), np.where(sure, 1.0, np.maximum(lam, _TINY))
    front = np.exp(-x + a * np.log(x) - _lgamma(a))
    # lower series where it converges fast, otherwise the upper fraction
    term = total = 1 / a
    n = a.copy()
    for _ in range(100_000):
        n = n + 1
        term = term * x / n
        total = total + term
        if np.all((np.abs(term) < np.abs(total) * 1e-16) | (x >= a + 1)):
            break
    else:
        raise ArithmeticError("the series does not converge")
    low = front * total
    b = x + 1 - a
    b = np.where(np.abs(b) < _TINY, _TINY, b)
    c, d = np.full_like(x, 1 / _TINY), 1 / b
    h = d.copy()
    for i in range(1, 100_000):
        num = -i * (i - a)
        b = b + 2
        d = num * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + num / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        h = h * d * c
        if np.all((np.abs(d * c - 1) < 1e-15) | (x < a + 1)):
            break
    else:
        raise ArithmeticError("the continued fraction does not converge")
    return np.where((k <= 0) | sure, 1.0, np.where(x < a + 1, low, 1 - front * h))


def _binomial_batch(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    out = np.ones(len(k))
    for rate in p.unique():
        at = (p == rate).to_numpy()
        out[at] = binomial_upper(k[at], n[at], float(rate))
    return pd.Series(out)


def _poisson_batch(k: pd.Series, lam: pd.Series) -> pd.Series:
    with np.errstate(all="ignore"):
        return pd.Series(poisson_upper(k.to_numpy(), lam.to_numpy()))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k), one Arrow batch at a time over aggregated rows."""
    return F.pandas_udf(_binomial_batch, T.DoubleType())(k, n, p)


def poisson_tail(k: Column, lam: Column) -> Column:
    return F.pandas_udf(_poisson_batch, T.DoubleType())(k, lam)
