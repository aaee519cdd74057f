"""Special functions that SQL lacks, as Arrow-batched functions over the few rows that statistics are."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function: a series below a + 1, Lentz's continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return min(1.0, max(0.0, 1 - scale * total))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = i * (a - i)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, max(0.0, scale * h))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + top * d) or 1e-300)
        c = (1 + top / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if beta_cdf(middle, a, b) < p else (low, middle)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def chi_square_p(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([gamma_upper(d / 2, x / 2) if d > 0 else 1.0 for x, d in zip(statistic, df, strict=True)])


def _clopper_pearson(k: float, n: float, alpha: float, upper: bool) -> float | None:
    if n < 10:
        return None
    if upper:
        return 1.0 if k >= n else beta_quantile(1 - alpha / 2, k + 1, n - k)
    return 0.0 if k <= 0 else beta_quantile(alpha / 2, k, n - k + 1)


@F.pandas_udf(DoubleType())
def clopper_pearson_lower(k: pd.Series, n: pd.Series) -> pd.Series:
    """At 95 %; null below ten trials."""
    return pd.Series([_clopper_pearson(a, b, 0.05, False) for a, b in zip(k, n, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def clopper_pearson_upper(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_clopper_pearson(a, b, 0.05, True) for a, b in zip(k, n, strict=True)], dtype="float64")
