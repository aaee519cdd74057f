"""Attribution of samples and of evidence to contributors, against leave-one-out backgrounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp, wilson
from .ordered import ranked

UNATTRIBUTED = "UNATTRIBUTED"
#: Texts that name no contributor.
EMPTY_NAMES = ("", "none", "null", "undefined")


def clean(contributors: Column) -> Column:
    """Trimmed, distinct and sorted names; UNATTRIBUTED alone if none is left."""
    kept = F.array_sort(F.array_distinct(F.filter(F.transform(contributors, lambda x: F.trim(x.cast("string"))), lambda x: x.isNotNull() & ~F.lower(x).isin(*EMPTY_NAMES))))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(F.lit(UNATTRIBUTED)))


def attribute(samples: DataFrame, contributors: str) -> DataFrame:
    """A row for each contributor of a sample: contributor, weight (1 / k), n_contributors; the other columns stay."""
    out = samples.withColumn("__c", clean(F.col(contributors))).withColumn("n_contributors", F.size("__c"))
    return out.withColumn("weight", 1.0 / F.col("n_contributors")).withColumn("contributor", F.explode("__c")).drop("__c", contributors)


def exposures(attributed: DataFrame) -> DataFrame:
    return attributed.groupBy("contributor").agg(F.sum("weight").alias("exposure"), F.count("*").alias("n_samples"), F.sum((F.col("n_contributors") > 1).cast("long")).alias("n_shared"))


def _background(count: Column, exposure: Column, all_count: Column, all_exposure: Column) -> tuple[Column, Column, Column]:
    n = F.greatest(F.lit(0.0), all_exposure - exposure)
    k = F.greatest(F.lit(0.0), all_count - count)
    return k, n, F.when(n > 1e-9, clamp(k / n))


def rates(attributed: DataFrame, metrics: Sequence[str], confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """A row for each contributor (within each group of by) and metric (boolean columns): rate, Wilson bounds, leave-one-out background,
    differential and its standard error, share of all anomalies. No background: null, not zero."""
    counts = attributed.groupBy(*by, "contributor").agg(F.sum("weight").alias("exposure"), *(F.sum(F.when(F.col(m), F.col("weight")).otherwise(0.0)).alias(m) for m in metrics))
    long = counts.select(*by, "contributor", "exposure", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("count")) for m in metrics))).alias("x")).select(*by, "contributor", "exposure", "x.metric", "x.count")
    totals = long.groupBy(*by, "metric").agg(F.sum("exposure").alias("all_exposure"), F.sum("count").alias("all_count"))
    out = long.join(totals, [*by, "metric"])
    rate, low, high = wilson(F.col("count"), F.col("exposure"), confidence)
    bg_count, bg_exposure, bg_rate = _background(F.col("count"), F.col("exposure"), F.col("all_count"), F.col("all_exposure"))
    out = out.withColumns({"rate": rate, "wilson_low": low, "wilson_high": high, "bg_count": bg_count, "bg_exposure": bg_exposure, "bg_rate": bg_rate})
    var = F.col("rate") * (1 - F.col("rate")) / F.greatest(F.lit(1e-4), F.col("exposure")) + F.col("bg_rate") * (1 - F.col("bg_rate")) / F.greatest(F.lit(1e-4), F.col("bg_exposure"))
    out = out.withColumns({"differential": F.col("rate") - F.col("bg_rate"), "standard_error": F.sqrt(F.greatest(F.lit(0.0), var)), "share": F.when(F.col("all_count") > 0, clamp(F.col("count") / F.col("all_count"))).otherwise(0.0)})
    return out.withColumn("baseline_status", F.when(F.col("bg_rate").isNull(), "INSUFFICIENT_BACKGROUND_SUPPORT").otherwise("VALID"))


def class_entropy(attributed: DataFrame, label: str) -> DataFrame:
    """contributor, entropy (bits), top_class, top_share of the weighted class distribution."""
    c = attributed.groupBy("contributor", F.col(label).alias("label")).agg(F.sum("weight").alias("w"))
    t = c.groupBy("contributor").agg(F.sum("w").alias("t"))
    p = F.col("w") / F.col("t")
    out = c.join(t, "contributor").groupBy("contributor").agg(F.greatest(F.lit(0.0), -F.sum(p * F.log2(p))).alias("entropy"), F.max(F.struct(F.round(p, 9).alias("p"), F.col("label"))).alias("x"))
    return out.select("contributor", "entropy", F.col("x.label").alias("top_class"), F.col("x.p").alias("top_share"))


def concentration(rated: DataFrame) -> DataFrame:
    """metric, hhi: Herfindahl index of the contributors' normalized shares of a metric's anomalies."""
    s = rated.where("share > 0")
    t = s.groupBy("metric").agg(F.sum("share").alias("t"))
    return s.join(t, "metric").groupBy("metric").agg(clamp(F.sum((F.col("share") / F.col("t")) ** 2)).alias("hhi"))


def gini(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, gini of the values at or above 0, by their ranks."""
    own = df.where(F.col(value) >= 0).select(*keys, F.col(value).cast("double").alias("v"))
    r = ranked(own, list(keys), "v", "i")
    out = r.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum((F.col("i") + 1) * F.col("v")).alias("x"))
    return out.select(*keys, F.when((F.col("n") <= 1) | (F.col("s") == 0), 0.0).otherwise(clamp(2 * F.col("x") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n"))).alias("gini"))


def shrink(rated: DataFrame, prior: float = 20.0, tiers: tuple[float, float, float] = (3, 10, 30)) -> DataFrame:
    """Empirical-Bayes shrinkage of rate towards bg_rate, with support tiers and tiered confidence. Below the first tier nothing is claimed."""
    n = F.col("exposure")
    mu = F.coalesce("bg_rate", F.lit(0.0))
    lam = n / (n + prior)
    state = F.when(n < tiers[0], "UNVERIFIABLE").when(n < tiers[1], "LOW_SUPPORT").when(n < tiers[2], "MODERATE_SUPPORT").otherwise("ADEQUATE_SUPPORT")
    out = rated.withColumn("support_state", state)
    none = F.col("support_state") == "UNVERIFIABLE"
    shrunk = F.when(none, mu).otherwise(clamp(lam * F.col("rate") + (1 - lam) * mu))
    out = out.withColumn("shrunk_rate", shrunk).withColumn("shrinkage", F.when(none, 0.0).otherwise(lam))
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("shrunk_rate") * (1 - F.col("shrunk_rate")) / F.greatest(F.lit(1.0), n + prior) + mu * (1 - mu) / F.greatest(F.lit(1.0), F.col("bg_exposure"))))
    conf = F.when(none, 0.0).when(n < tiers[1], F.least(F.lit(0.5), n / 10 * 0.5)).when(n < tiers[2], F.least(F.lit(0.85), 0.5 + 0.35 * (n - 10) / 20)).otherwise(F.least(F.lit(0.99), 0.85 + 0.14 * (1 - F.exp(-0.05 * (n - 30)))))
    return out.withColumns({"eb_differential": F.when(none, 0.0).otherwise(F.col("shrunk_rate") - mu), "eb_standard_error": F.when(none, 0.0).otherwise(se), "confidence": conf})


def findings(attributed: DataFrame, label: str, metrics: Sequence[str], support: float = 5, share_at: float = 0.5, hhi_at: float = 0.4, flip_at: float = 0.3) -> DataFrame:
    """contributor, category, severity, confidence: one row a finding."""
    rated = rates(attributed, metrics).join(concentration(rates(attributed, metrics)), "metric", "left")
    expo = exposures(attributed)
    enough = (F.col("exposure") >= support) & (F.col("contributor") != UNATTRIBUTED)
    row = lambda category, severity, confidence: [F.lit(category).alias("category"), F.lit(severity).alias("severity"), confidence.cast("double").alias("confidence")]
    counted = enough & (F.col("count") > 0)
    parts = [
        expo.where((F.col("exposure") < support) & (F.col("contributor") != UNATTRIBUTED)).select("contributor", *row("INSUFFICIENT_CONTRIBUTOR_SUPPORT", "LOW", F.lit(0.0))),
        rated.where((F.col("contributor") == UNATTRIBUTED) & (F.col("count") > 0)).select("contributor").distinct().select("contributor", *row("UNATTRIBUTED_EVIDENCE", "LOW", F.lit(1.0))),
        class_entropy(attributed, label).join(expo, "contributor").where(enough & (F.col("entropy") < 0.5) & (F.col("top_share") >= 0.85)).select("contributor", *row("CONTRIBUTOR_CLASS_DISTRIBUTION", "LOW", F.col("top_share"))),
        rated.where(enough & ((F.col("wilson_low") >= 0.05) | ((F.col("rate") > 0.15) & (F.col("count") >= 2)))).groupBy("contributor").agg(F.count("*").alias("n")).where("n >= 3").select("contributor", *row("CONTRIBUTOR_MULTI_SIGNAL_EVIDENCE", "HIGH", F.least(F.lit(1.0), 0.5 + 0.15 * F.col("n")))),
        rated.where(counted & (F.col("share") >= share_at) & (F.col("hhi") >= hhi_at)).select("contributor", *row("CONTRIBUTOR_ANOMALY_CONCENTRATION", "MEDIUM", F.col("share"))),
        rated.where(counted & (F.col("metric") == "label_flip") & (F.col("differential") >= flip_at)).select("contributor", *row("CONTRIBUTOR_LABEL_TRANSITION", "MEDIUM", clamp(F.col("wilson_low"), 0.5, 1.0))),
    ]
    for metric, category, diff, low in (("ood", "CONTRIBUTOR_OOD_CONCENTRATION", 0.25, 0.15), ("quality", "CONTRIBUTOR_QUALITY_CONCENTRATION", 0.30, 0.20), ("duplicate", "CONTRIBUTOR_DUPLICATE_CONCENTRATION", 0.25, 0.15)):
        hit = counted & (F.col("metric") == metric) & (F.col("differential") >= diff) & (F.col("wilson_low") >= low)
        parts.append(rated.where(hit).select("contributor", *row(category, "MEDIUM", F.least(F.lit(1.0), F.col("wilson_low") * 1.5))))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def risk(attributed: DataFrame, families: dict[str, Sequence[str]]) -> DataFrame:
    """contributor, the family of evidence with the largest shrunk differential, its value, and a status."""
    rated = shrink(rates(attributed, [m for ms in families.values() for m in ms]))
    family = F.coalesce(*(F.when(F.col("metric").isin(list(ms)), f) for f, ms in families.items()))
    best = rated.withColumn("family", family).groupBy("contributor").agg(F.max(F.struct(F.round("eb_differential", 9).alias("d"), F.col("family"), F.col("confidence"), F.col("support_state"))).alias("x"))
    status = F.when(F.col("x.support_state") == "UNVERIFIABLE", "UNVERIFIABLE").when(F.col("x.d") >= 0.25, "HIGH_DIFFERENTIAL").when(F.col("x.d") >= 0.10, "ELEVATED").otherwise("WITHIN_BASELINE")
    return best.select("contributor", F.col("x.family").alias("family"), F.col("x.d").alias("differential"), F.col("x.confidence").alias("confidence"), status.alias("status"))
