"""Profiles of model outputs by kind, time accounting, and records kept as maps or JSON texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clamp, dual_gate
from . import drift, profiles, vectors
from .multiple_testing import adjust


def detection_profile(images: DataFrame, boxes: DataFrame, image: str) -> DataFrame:
    """A row for each measure (count of boxes an image, confidence, area): n, min, max, mean, std, quartiles, p95, zero_share (of the counts: images
    without boxes). images: a row an image; boxes: image, box (x1, y1, x2, y2), score."""
    area = F.greatest(F.lit(0.0), (F.get("box", F.lit(2)) - F.get("box", F.lit(0))) * (F.get("box", F.lit(3)) - F.get("box", F.lit(1))))
    counts = images.select(image).join(boxes.groupBy(image).agg(F.count("*").alias("k")), image, "left").select(F.lit("count").alias("measure"), F.coalesce("k", F.lit(0)).cast("double").alias("value"))
    long = counts.union(boxes.select(F.lit("confidence"), F.col("score").cast("double"))).union(boxes.select(F.lit("area"), area))
    zeros = long.groupBy("measure").agg(F.avg((F.col("value") == 0).cast("double")).alias("zero_share"))
    return profiles.five_number(long, ["measure"], "value").join(zeros, "measure")


def class_frequency(boxes: DataFrame, label: str = "label") -> DataFrame:
    return boxes.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("0")).alias("label")).agg(F.count("*").alias("n"))


def segmentation_profile(masks: DataFrame, mask: str, agreement: Column | None = None, truth: bool = False) -> DataFrame:
    """A row for each class: class, n_pixels, share; and, alike in all rows, n_masks, evaluation_case and mean_iou (of agreement, a mask's mean
    intersection over union with its truth or with another model's mask)."""
    pixels = masks.select(F.explode(mask).alias("class")).groupBy("class").agg(F.count("*").alias("n_pixels"))
    whole = pixels.agg(F.sum("n_pixels").alias("__n"))
    facts = masks.agg(F.count("*").alias("n_masks"), (F.avg(agreement) if agreement is not None else F.lit(None).cast("double")).alias("mean_iou"))
    case = "UNAVAILABLE" if agreement is None else "GROUND_TRUTH_mIoU" if truth else "REFERENCE_MASK_AGREEMENT"
    out = pixels.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(facts))  # one row each
    return out.select("class", "n_pixels", (F.col("n_pixels") / F.col("__n")).alias("share"), "n_masks", F.lit(case).alias("evaluation_case"), "mean_iou")


def latency_profile(runs: DataFrame, latency: str, bound_to: Sequence[str] = ("execution_provider", "device", "runtime_version", "precision")) -> DataFrame:
    """The five-number profile of latencies for each identity of the hardware and runtime that they were measured on."""
    return profiles.five_number(runs, [c for c in bound_to if c in runs.columns], latency)


def joint_drift(long: DataFrame, labels: DataFrame, method: str = "bh", level: float = 0.05, multivariate: DataFrame | None = None) -> DataFrame:
    """All features of one comparison under one correction: feature, kind, statistic, p_value, adjusted_p, significant, practical, status. long: is_target,
    feature, value; labels: is_target, feature, label; multivariate: rows (feature, statistic, p_value, practical), say of permutation tests."""
    numeric = drift.features(long, level, method="none").select("feature", F.lit("CONTINUOUS").alias("kind"), F.col("ks").alias("statistic"), "p_value", ((F.col("psi") >= 0.10) | (F.col("w1_std") >= 0.10)).alias("practical"))
    classes = drift.categorical(labels, keys=["feature"], level=level)
    classes = classes.select("feature", F.lit("CATEGORICAL").alias("kind"), F.col("tvd").alias("statistic"), "p_value", ((F.col("tvd") >= 0.05) | (F.col("jsd") >= 0.02) | (F.size("unseen") > 0)).alias("practical"))
    every = numeric.union(classes)
    if multivariate is not None:
        every = every.union(multivariate.select("feature", F.lit("MULTIVARIATE").alias("kind"), "statistic", "p_value", "practical"))
    out = adjust(every, method, level, name="feature")
    return out.withColumn("status", dual_gate(F.col("significant"), F.col("practical"))).drop("rank", "critical")


def global_drift(joint: DataFrame) -> DataFrame:
    """One row: n_features, n_significant, n_material, status: the gravest of the features'."""
    grave = F.max(F.when(F.col("status") == "MATERIAL_SHIFT", 3).when(F.col("status") == "SIGNIFICANT_SHIFT", 2).when(F.col("status") == "SHIFT_DETECTED", 1).otherwise(0))
    out = joint.agg(F.count("*").alias("n_features"), F.sum(F.col("significant").cast("long")).alias("n_significant"), F.sum((F.col("status") == "MATERIAL_SHIFT").cast("long")).alias("n_material"), grave.alias("g"))
    names = F.array(*(F.lit(x) for x in ("NO_SHIFT_DETECTED", "SHIFT_DETECTED", "SIGNIFICANT_SHIFT", "MATERIAL_SHIFT")))
    return out.withColumn("status", F.element_at(names, F.coalesce("g", F.lit(0)) + 1)).drop("g")


def novelty_shift(x: DataFrame, y: DataFrame, permutations: int = 50, level: float = 0.05, mmd_at: float = 0.02, energy_at: float = 1.0, divergence_at: float = 0.05) -> DataFrame:
    """One row of two tables (v): mmd and energy (square roots), p_value by permutations, shifted, diverges (mean gap of the components' means)."""
    energy = float(vectors.energy_distance(x, y).first()[0]) ** 0.5
    means = [t.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")) for t in (x, y)]
    gap = means[0].join(means[1].withColumnRenamed("m", "n"), "i").agg(F.avg(F.abs(F.col("m") - F.col("n"))).alias("gap"))
    test = vectors.permutation_mmd(x, y, vectors.median_gamma(x, y), permutations)
    out = test.crossJoin(F.broadcast(gap)).withColumn("mmd", F.sqrt(F.greatest(F.lit(0.0), F.col("observed")))).withColumn("energy", F.lit(energy))
    shifted = (F.col("mmd") > mmd_at) & ((F.col("p_value") < level) | (F.col("energy") > energy_at))
    return out.select("mmd", "energy", "p_value", shifted.alias("shifted"), (F.col("gap") > divergence_at).alias("diverges"))


def time_accounting(observed: DataFrame, raw: str, parsed: Column, keys: Sequence[str] = (), delay_s: int = 0) -> DataFrame:
    """keys, n, n_missing, n_invalid, n_late, n_valid of observations: missing without a time, invalid where none can be read from it, late where
    it is more than delay_s before the newest of its key."""
    rows = observed.select(*keys, F.col(raw).cast("string").alias("raw"), parsed.alias("at"))
    newest = rows.groupBy(*keys).agg(F.max("at").alias("newest"))
    marked = rows.join(newest, list(keys)) if keys else rows.crossJoin(F.broadcast(newest))  # one row
    missing = F.coalesce(F.trim("raw"), F.lit("")) == ""
    late = F.coalesce(F.unix_micros("newest") - F.unix_micros("at") > delay_s * 1_000_000, F.lit(False))
    n = lambda c: F.sum(c.cast("long"))
    return marked.groupBy(*keys).agg(F.count("*").alias("n"), n(missing).alias("n_missing"), n(~missing & F.col("at").isNull()).alias("n_invalid"), n(late).alias("n_late"), n(F.col("at").isNotNull() & ~late).alias("n_valid"))


def canonical_second(time: Column) -> Column:
    """UTC time to the second, as signed records carry it."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def has_duplicate_keys(json: Column) -> Column:
    """Whether an object's JSON text names a key twice; null if it isn't an object."""
    keys = F.json_object_keys(json)
    return F.when(keys.isNotNull(), F.size(keys) > F.size(F.array_distinct(keys)))


def sorted_items(m: Column) -> Column:
    """A map's entries by key."""
    return F.array_sort(F.map_entries(m))


def merged(base: Column, over: Column) -> Column:
    """Both maps' entries; over's where both have a key."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def same_map(a: Column, b: Column) -> Column:
    """Maps are equal by their sorted entries, whatever their order; null equals null."""
    return sorted_items(a).eqNullSafe(sorted_items(b))


def hierarchy(assets: DataFrame, projects: DataFrame) -> DataFrame:
    """Assets' and projects' risks as one table: tier, project_id, asset_id, risk, level, sufficiency (a project's: the worst of its assets')."""
    enough = F.when(F.col("sufficient"), "SUFFICIENT").otherwise("INSUFFICIENT_ANCESTRY")
    own = assets.select(F.lit("ASSET").alias("tier"), "project_id", "asset_id", clamp(F.col("risk")).alias("risk"), "level", enough.alias("sufficiency"))
    worst = assets.groupBy("project_id").agg(F.min("sufficient").alias("sufficient"))
    return own.union(projects.join(worst, "project_id").select(F.lit("PROJECT"), "project_id", F.lit(None).cast("string"), "risk", "level", enough))
