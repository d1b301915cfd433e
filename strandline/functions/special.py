"""Special functions and root finding for kernels; scalar expressions for columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def expm1(x: float) -> float:
    """expm1 that ends at infinity instead of failing."""
    return math.expm1(x) if x < 700 else math.inf


def invert(f: Callable[[float], float], value: float, low: float, high: float, rounds: int = 200) -> float:
    """x in [low, high] with f(x) = value for an increasing f, by bisection; an end if it lies beyond."""
    if f(low) >= value:
        return low
    if f(high) <= value:
        return high
    for _ in range(rounds):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if f(mid) < value else (low, mid)
    return (low + high) / 2


def log_binomial(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def binomial_pmf(k: int, n: int, p: float) -> float:
    if p <= 0 or p >= 1:
        return float(k == (n if p >= 1 else 0))
    return math.exp(log_binomial(n, k) + k * math.log(p) + (n - k) * math.log1p(-p))


def normal_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def hypergeometric_sf(k: int, n: int, marked: int, drawn: int) -> float:
    """Chance of k or more marked ones among ``drawn`` of n."""
    low, high = max(k, drawn - (n - marked), 0), min(marked, drawn)
    whole = log_binomial(n, drawn)
    return min(1.0, sum(math.exp(log_binomial(marked, i) + log_binomial(n - marked, drawn - i) - whole) for i in range(low, high + 1)))


def poisson_pmf(k: int, mean: float) -> float:
    return float(k == 0) if mean <= 0 else math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
    # Lentz's method for the upper function.
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b) if an * d + b else 1e300
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def poisson_sf(k: int, mean: float) -> float:
    """Chance of k or more."""
    return 1.0 if k <= 0 else gammainc(k, mean)


def beta_pdf(x: float, a: float, b: float) -> float:
    if not 0 < x < 1:
        return 0.0
    return math.exp((a - 1) * math.log(x) + (b - 1) * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))


def gauss_hermite(f: Callable[[np.ndarray], np.ndarray], mean: float, sd: float, n: int = 32) -> float:
    """The mean of f over a normal variable."""
    x, w = np.polynomial.hermite.hermgauss(n)
    return float((w * f(mean + math.sqrt(2) * sd * x)).sum() / math.sqrt(math.pi))


# Columns.


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def x_ln_y(x: Column, y: Column) -> Column:
    """x ln y, and 0 for x = 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.log(y))


def kl_bernoulli(p: Column, q: Column) -> Column:
    return x_ln_y(p, p / q) + x_ln_y(1 - p, (1 - p) / (1 - q))


def fisher_z(r: Column) -> Column:
    return F.atanh(r)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common start of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b)).cast("long"))


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal law; null for null."""

    def run(z: pd.Series) -> pd.Series:
        known, which = np.unique(z.to_numpy(float), return_inverse=True)
        return pd.Series(np.array([normal_sf(x) for x in known])[which]).where(z.notna().to_numpy())

    return F.pandas_udf(run, "double")(z)


def hypergeometric_tails(k: np.ndarray, n: np.ndarray, marked: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """``hypergeometric_sf`` of many; one table of log factorials, and a step for each number of marked ones."""
    table = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, int(n.max()) + 1 if len(n) else 1)))))
    choose = lambda a, b: table[a] - table[b] - table[a - b]
    low, high = np.maximum(np.maximum(k, drawn - (n - marked)), 0), np.minimum(marked, drawn)
    total, i = np.zeros(len(k)), low.copy()
    left = np.flatnonzero(i <= high)
    while len(left):
        own = i[left]
        total[left] += np.exp(choose(marked[left], own) + choose(n[left] - marked[left], drawn[left] - own) - choose(n[left], drawn[left]))
        i[left] += 1
        left = left[i[left] <= high[left]]
    return np.minimum(total, 1.0)


def hypergeometric_tail(k: Column, n: Column, marked: Column, drawn: Column) -> Column:
    """Chance of k or more marked ones among ``drawn`` of n; the table has as many rows as the largest n."""

    def run(k: pd.Series, n: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
        rows, which = np.unique(np.stack([x.to_numpy(np.int64) for x in (k, n, marked, drawn)]), axis=1, return_inverse=True)
        return pd.Series(hypergeometric_tails(*rows)[which.ravel()])

    return F.pandas_udf(run, "double")(k, n, marked, drawn)
