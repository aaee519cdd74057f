"""Behaviour profiles and robust anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import support_status
from .ordered import median_mad, quantiles, ranges_for, running, value_counts

#: Which side of a metric's baseline is extreme; metrics that aren't named are two-sided.
HIGHER, LOWER, TWO_SIDED = "HIGHER_IS_EXTREME", "LOWER_IS_EXTREME", "TWO_SIDED"


def five_number(df: DataFrame, keys: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """keys, n (non-finite and null values counted), min, max, mean, std (population), p25, median, p75, p95 of the finite values."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    plain = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(finite).alias("min"), F.max(finite).alias("max"), F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("std"))
    q = quantiles(df, keys, value, {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}, ranges).drop("n")
    return plain.join(q, list(keys), "left") if keys else plain.crossJoin(F.broadcast(q))  # one row


def class_profile(df: DataFrame, keys: Sequence[str], probabilities: str) -> DataFrame:
    """keys, top1, n, share, confidence, entropy (nats) and margin means of rows by their likeliest class; rows with non-finite values don't count."""
    p = F.col(probabilities)
    good = df.where(F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    top = F.array_max(p)
    clipped = F.transform(p, lambda x: F.greatest(F.lit(1e-12), F.least(F.lit(1.0), x)))
    total = F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)
    entropy = F.aggregate(clipped, F.lit(0.0), lambda a, x: a - x / total * F.log(x / total))
    rows = good.select(*keys, (F.array_position(p, top) - 1).cast("int").alias("top1"), top.alias("c"), entropy.alias("e"), (top - F.element_at(F.sort_array(p), -2)).alias("m"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    out = rows.groupBy(*keys, "top1").agg(F.count("*").alias("n"), F.avg("c").alias("confidence"), F.avg("e").alias("entropy"), F.avg("m").alias("margin"))
    out = out.join(n, list(keys)) if keys else out.crossJoin(F.broadcast(n))  # one row
    return out.withColumn("share", F.col("n") / F.col("__n")).drop("__n")


def evaluate_metrics(observed: DataFrame, baseline: DataFrame, direction: Column | None = None, z_at: float = 3.5, tail_at: float = 0.01, least: int = 5, ranges: int | None = None) -> DataFrame:
    """Each row of observed (metric, value) against the metric's baseline (metric, value): robust z, empirical tail and status.

    A zero MAD makes any difference from the median anomalous. Tails come from the counts of distinct baseline values: a value meets only
    the greatest baseline value at or below it and the counts there."""
    direction = direction if direction is not None else F.lit(TWO_SIDED)
    ranges = ranges_for(baseline, ["metric"]) if ranges is None else ranges
    middle = median_mad(baseline, ["metric"], "value", ranges)
    counts = value_counts(baseline, ["metric"], "value", ranges)
    # as-of by union: baseline values and observed ones in one order, the running count carried over
    marks = counts.select("metric", "value", F.col("c"), F.lit(True).alias("is_base")).union(observed.select("metric", F.col("value").cast("double"), F.lit(0).cast("long"), F.lit(False)).distinct())
    at = running(marks, ["metric"], "value", {"le": F.col("c")}, ranges)
    equal = counts.select("metric", "value", F.col("c").alias("eq"))
    tails = at.where(~F.col("is_base")).select("metric", "value", "le").join(equal, ["metric", "value"], "left")
    out = observed.withColumn("value", F.col("value").cast("double")).join(middle, "metric", "left").join(tails, ["metric", "value"], "left").withColumn("direction", direction)
    n = F.col("n").cast("double")
    p_le, p_ge = F.col("le") / n, (F.col("n") - F.col("le") + F.coalesce("eq", F.lit(0))) / n
    tail = F.when(F.col("direction") == LOWER, p_le).when(F.col("direction") == HIGHER, p_ge).otherwise(F.least(F.lit(1.0), 2 * F.least(p_le, p_ge)))
    out = out.withColumn("robust_z", F.when(F.col("mad") > 0, (F.col("value") - F.col("median")) / (1.4826 * F.col("mad")))).withColumn("tail", tail)
    z = F.col("robust_z")
    far = F.when(F.col("direction") == HIGHER, z >= z_at).when(F.col("direction") == LOWER, z <= -z_at).otherwise(F.abs(z) >= z_at)
    odd = F.when(F.col("mad") > 0, far | (F.col("tail") <= tail_at)).otherwise(F.col("value") != F.col("median"))
    status = F.when(F.col("value").isNull(), "UNAVAILABLE").when(F.coalesce("n", F.lit(0)) < least, "INSUFFICIENT_SUPPORT").when(odd, "ANOMALOUS").otherwise("NORMAL")
    keep_z = F.coalesce("n", F.lit(0)) >= least
    return out.withColumn("status", status).withColumn("robust_z", F.when(keep_z, z)).withColumn("tail", F.when(keep_z, F.col("tail"))).withColumn("support", support_status(F.coalesce("n", F.lit(0)))).drop("le", "eq")


def family_rollup(metrics: DataFrame, keys: Sequence[str], family: str = "family") -> DataFrame:
    """keys, family, n_valid, n_anomalous, status over evaluated metrics."""
    valid = F.col("status").isin("NORMAL", "ANOMALOUS")
    out = metrics.groupBy(*keys, family).agg(F.count("*").alias("n_metrics"), F.sum(valid.cast("long")).alias("n_valid"), F.sum((F.col("status") == "ANOMALOUS").cast("long")).alias("n_anomalous"))
    return out.withColumn("status", F.when(F.col("n_anomalous") > 0, "ANOMALOUS").when(F.col("n_valid") == 0, "INSUFFICIENT_SUPPORT").otherwise("NORMAL"))


def percentile_rank(observed: DataFrame, baseline: DataFrame, ranges: int | None = None) -> DataFrame:
    """observed (metric, value) with its mid-rank percentile in the baseline."""
    counts = baseline.groupBy("metric", "value").agg(F.count("*").alias("c"))
    marks = counts.withColumn("is_base", F.lit(True)).select("metric", F.col("value").cast("double"), "c", "is_base").union(observed.select("metric", F.col("value").cast("double"), F.lit(0).cast("long"), F.lit(False)).distinct())
    at = running(marks, ["metric"], "value", {"le": F.col("c")}, ranges)
    n = counts.groupBy("metric").agg(F.sum("c").alias("n"))
    eq = counts.select("metric", F.col("value").cast("double").alias("value"), F.col("c").alias("eq"))
    place = at.where(~F.col("is_base")).select("metric", "value", "le").join(eq, ["metric", "value"], "left").join(n, "metric")
    share = (F.col("le") - F.coalesce("eq", F.lit(0)) / 2.0) / F.col("n") * 100
    return observed.withColumn("value", F.col("value").cast("double")).join(place.select("metric", "value", share.alias("percentile")), ["metric", "value"], "left").fillna({"percentile": 50.0})
