"""Closed forms as Column expressions: they stay in the JVM and in code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantiles of the confidence levels that are exact; any other level takes 1.96.
Z = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; null stays null (least and greatest alone would pass over it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def round6(x: Column) -> Column:
    """Half-up rounding to six places, in decimals. Sums of doubles differ in their last bits by the order of their terms; the twelfth place is free of that."""
    return F.round(x.cast("decimal(28,12)"), 6).cast("double")


def z_of(confidence: float) -> float:
    return next((z for level, z in Z.items() if math.isclose(confidence, level, rel_tol=1e-3)), 1.96)


def wilson(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column, Column]:
    """Rate, lower and upper bound; all 0 without exposure."""
    z = z_of(confidence)
    n = F.when(n > 0, n)
    p = clamp(k / n)
    denominator = 1 + z * z / n
    center = (p + z * z / (2 * n)) / denominator
    margin = z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n + z * z / (4 * n * n))) / denominator
    return F.coalesce(p, F.lit(0.0)), F.coalesce(clamp(center - margin), F.lit(0.0)), F.coalesce(clamp(center + margin), F.lit(0.0))


def wilson_lower(p: Column, n: Column, z: float = 1.96) -> Column:
    p, n = clamp(p), F.when(n > 0, n)
    value = (p + z * z / (2 * n) - z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n + z * z / (4 * n * n)))) / (1 + z * z / n)
    return F.when(p > 0, F.coalesce(clamp(value), F.lit(0.0))).otherwise(F.lit(0.0))


def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Stephens' approximation: an alternating series of at most 100 terms."""
    root = F.sqrt(n1 * n2 / (n1 + n2))
    lam = F.greatest(F.lit(0.0), (root + 0.12 + 0.11 / root) * d)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam <= 1e-8, 1.0).when(lam > 5.0, 0.0).otherwise(clamp(series))


def noisy_or(score: Column) -> Column:
    """Aggregate: 1 - product(1 - score)."""
    return 1 - F.product(1 - score)


def dual_gate(significant: Column, practical: Column) -> Column:
    return F.when(significant & practical, "MATERIAL_SHIFT").when(significant, "SIGNIFICANT_SHIFT").when(practical, "SHIFT_DETECTED").otherwise("NO_SHIFT_DETECTED")


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.85, "CRITICAL").when(score >= 0.65, "HIGH").when(score >= 0.30, "MEDIUM").when(score > 0, "LOW").otherwise("NONE")


def support_status(n: Column) -> Column:
    return F.when(n < 5, "INSUFFICIENT_SUPPORT").when(n < 10, "LOW_SUPPORT").when(n < 30, "MODERATE_SUPPORT").otherwise("ADEQUATE_SUPPORT")
