"""Trigger activation: what counts as a reaction of a model to a trigger, rates under trigger and controls, and their analysis.

An observation is a row for a candidate trigger, a sample and a condition (trigger, shuffled, noise): the model's output on the clean input (clean) and
under the condition (output). Decisions are Column expressions, so that assessing is one aggregation over the observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import clopper_pearson_lower, clopper_pearson_upper
from . import inference, paired, vectors
from .multiple_testing import adjust

CONDITIONS = ("trigger", "shuffled", "noise")
EDGE = 1e-9  # a drop that reaches its threshold but for the last bits counts


def _decision(metric: str, value: Column, activated: Column, status: Column | None = None, matched: Column | None = None) -> Column:
    """status: null where the outputs can be judged, else why not."""
    why = F.lit(None).cast("string") if status is None else status
    outcome = F.when(why.startswith("UNAVAILABLE"), "UNAVAILABLE").when(why.isNotNull() | activated.isNull(), "NOT_APPLICABLE").when(activated, "ACTIVATED").otherwise("NOT_ACTIVATED")
    target = F.lit(None).cast("boolean") if matched is None else F.when(why.isNull(), matched)
    return F.struct(F.lit(metric).alias("metric"), F.when(why.isNull(), value.cast("double")).alias("value"), outcome.alias("decision"), F.coalesce(why, F.lit("VALID")).alias("status"), target.alias("target_matched"))


def _array_status(clean: Column, output: Column) -> Column:
    finite = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    s = F.when(clean.isNull() | output.isNull(), "UNAVAILABLE_NON_ARRAY_OUTPUT").when((F.size(clean) == 0) | (F.size(output) == 0), "EMPTY_ARRAY").when(~finite(clean) | ~finite(output), "NON_FINITE_VALUES")
    return s.when(F.size(clean) != F.size(output), "INCOMPATIBLE_SHAPE")


def _classes(metric: str, a: Column, b: Column, value: Column, activated: Column, target: int | None = None) -> Column:
    """Outputs of a single number have no classes: they count as activated where they move at all."""
    status, one = _array_status(a, b), F.size(a) < 2
    moved = F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0)))
    several = _decision(metric, value, activated, status, None if target is None else _likeliest(b) == target)
    return F.when(status.isNull() & one, _decision("tensor_l2_distance_fallback", moved, moved > 1e-4)).otherwise(several)


def _likeliest(v: Column) -> Column:
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def prediction_changed(clean: Column, output: Column, target: int | None = None) -> Column:
    a, b = vectors.doubles(clean), vectors.doubles(output)
    return _classes("discrete_prediction_change", a, b, _likeliest(b), _likeliest(a) != _likeliest(b), target)


def target_matched(clean: Column, output: Column, target: int | None) -> Column:
    a, b = vectors.doubles(clean), vectors.doubles(output)
    if target is None:
        return _decision("target_class_prediction_match", _likeliest(b), F.lit(False), F.lit("NOT_APPLICABLE_NO_TARGET"))
    return _classes("target_class_prediction_match", a, b, _likeliest(b), _likeliest(b) == target, target)


def confidence_drop(clean: Column, output: Column, at: float = 0.20, target: int | None = None) -> Column:
    """How far the clean input's class loses."""
    a, b = vectors.doubles(clean), vectors.doubles(output)
    drop = F.array_max(a) - F.get(b, _likeliest(a))
    return _classes("clean_class_confidence_drop", a, b, drop, drop >= at, target)


def tensor_distance(clean: Column, output: Column, at: float = 0.10) -> Column:
    a, b = vectors.doubles(clean), vectors.doubles(output)
    gap = F.zip_with(a, b, lambda x, y: x - y)
    l2 = F.sqrt(vectors.dot(gap, gap))
    return _decision("tensor_l2_distance", l2, l2 >= at, _array_status(a, b))


def _boxes_status(clean: Column, output: Column) -> Column:
    return F.when(clean.isNull() | output.isNull(), "UNAVAILABLE_INCOMPATIBLE_DETECTION_FORMAT")


def detection_count(clean: Column, output: Column, at: int = 1) -> Column:
    """Boxes: arrays of (box, label, score)."""
    delta = F.size(output) - F.size(clean)
    return _decision("abs_detection_count_delta", delta, F.abs(delta) >= at, _boxes_status(clean, output))


def detection_injected(clean: Column, output: Column, target: object | None) -> Column:
    """The target's class is detected that the clean input doesn't show."""
    if target is None:
        return _decision("target_class_injection", F.lit(0), F.lit(False), F.lit("NOT_APPLICABLE_NO_TARGET"))
    has = lambda v: F.exists(v, lambda x: x["label"].cast("string") == str(target))
    return _decision("target_class_injection", has(output).cast("int"), has(output) & ~has(clean), _boxes_status(clean, output), has(output) & ~has(clean))


def detection_iou_drop(clean: Column, output: Column, truth: Column | None = None, match_at: float = 0.50, at: float = 0.10) -> Column:
    """Loss of the matched boxes' mean IoU against the truth or, without one, against the clean input's boxes."""
    base = clean if truth is None else F.coalesce(truth, clean)
    both = lambda v: inference.matched(base, v, match_at)["mean_iou"]
    drop = both(clean) - both(output)
    return _decision("delta_detection_iou", drop, drop >= at - EDGE, _boxes_status(clean, output))


def _mask_status(*masks: Column, missing: str = "UNAVAILABLE_INCOMPATIBLE_SEGMENTATION_FORMAT") -> Column:
    first, *others = masks
    unlike = F.lit(False)
    for m in others:
        unlike = unlike | (F.size(m) != F.size(first))
    absent = F.lit(False)
    for m in masks:
        absent = absent | m.isNull()
    return F.when(absent, missing).when(unlike | (F.size(first) == 0), "UNAVAILABLE_INCOMPATIBLE_SEGMENTATION_FORMAT")


def mask_disagreement(clean: Column, output: Column, classes: int, at: float = 0.10) -> Column:
    """Share of the classes' mean IoU that clean and condition's masks don't have in common."""
    gap = 1 - inference.mask_agreement(clean, output, classes)["mean_iou"]
    return _decision("clean_vs_condition_mask_disagreement", gap, gap >= at - EDGE, _mask_status(clean, output))


def mask_truth_drop(clean: Column, output: Column, truth: Column, classes: int, at: float = 0.10) -> Column:
    drop = inference.mask_agreement(truth, clean, classes)["mean_iou"] - inference.mask_agreement(truth, output, classes)["mean_iou"]
    why = F.coalesce(_mask_status(clean, output), _mask_status(clean, truth, missing="UNAVAILABLE_GROUND_TRUTH_MISSING"))
    return _decision("delta_ground_truth_miou", drop, drop >= at - EDGE, why)


def mask_reference_drop(clean: Column, output: Column, reference: Column, classes: int, at: float = 0.10) -> Column:
    """Loss of agreement with another model's mask."""
    drop = inference.mask_agreement(reference, clean, classes)["mean_iou"] - inference.mask_agreement(reference, output, classes)["mean_iou"]
    why = F.coalesce(_mask_status(clean, output), _mask_status(clean, reference, missing="UNAVAILABLE_REFERENCE_MODEL_MISSING"))
    return _decision("delta_reference_mask_agreement", drop, drop >= at - EDGE, why)


def mask_target_emergence(clean: Column, output: Column, target: int | None) -> Column:
    """The target's class has pixels where the clean mask has none at all."""
    if target is None:
        return _decision("target_class_pixel_emergence", F.lit(0), F.lit(False), F.lit("NOT_APPLICABLE_NO_TARGET"))
    n = lambda v: F.size(F.filter(v, lambda x: x == target))
    emerged = (n(output) > 0) & (n(clean) == 0)
    return _decision("target_class_pixel_emergence", n(output), emerged, F.when(clean.isNull() | output.isNull(), "UNAVAILABLE_INCOMPATIBLE_SEGMENTATION_FORMAT"), emerged)


def assess(decided: DataFrame, keys: Sequence[str], sample: str = "sample_id", condition: str = "condition", decision: str = "decision", target: bool = True, support: int = 10) -> DataFrame:
    """keys, n (samples seen under the trigger), tar and tsr (activated; at the target) under the trigger and both controls, support_status. decided:
    a row a sample and condition with a decision struct; a condition that was not run has null rates, and tsr is null without a target."""
    per = decided.groupBy(*keys, sample, condition).agg(F.max((F.col(decision)["decision"] == "ACTIVATED").cast("int")).alias("a"), F.max(F.coalesce(F.col(decision)["target_matched"], F.lit(False)).cast("int")).alias("t"))
    of = lambda name, c: F.avg(F.when(F.col(condition) == name, F.col(c)))
    n = F.count(F.when(F.col(condition) == "trigger", 1))
    tar = [of(x, "a").alias("tar" if x == "trigger" else f"tar_{x}") for x in CONDITIONS]
    tsr = [(of(x, "t") if target else F.lit(None).cast("double")).alias("tsr" if x == "trigger" else f"tsr_{x}") for x in CONDITIONS]
    return per.groupBy(*keys).agg(n.alias("n"), *tar, *tsr).withColumn("support_status", F.when(F.col("n") >= support, "SUPPORT_ELIGIBLE").otherwise("INSUFFICIENT_SUPPORT"))


def outcomes(decided: DataFrame, candidate: str, sample: str = "sample_id", condition: str = "condition", decision: str = "decision", clean_class: str | None = None, target: int | None = None) -> DataFrame:
    """candidate, sample, trigger, shuffled, noise (0 or 1) and activated: a sample succeeds where it reaches the target, or without one where it is activated.
    Samples that a clean input brings to the target already don't count; a control that was not run counts as none."""
    rows = decided if target is None or clean_class is None else decided.where(~F.col(clean_class).eqNullSafe(F.lit(target)))
    hit = F.col(decision)["decision"] == "ACTIVATED"
    success = hit if target is None else F.coalesce(F.col(decision)["target_matched"], F.lit(False))
    under = lambda name, c: F.coalesce(F.max(F.when(F.col(condition) == name, c.cast("int"))), F.lit(0))
    return rows.groupBy(candidate, sample).agg(*(under(x, success).alias(x) for x in CONDITIONS), under("trigger", hit).alias("activated"))


def analyse(paired_rows: DataFrame, candidate: str, target: bool = True, permutations: int = 1000, alpha: float = 0.05, promote: int = 2) -> DataFrame:
    """A row for each candidate: n, tar, tsr, controls' rates, separation, exact bounds of the success rate, p_value and BH-adjusted p over all candidates, significant, result
    (taxonomy), status and rank of its promotion. Without ten pairs there is no p-value and a candidate takes no part in the correction."""
    rates = paired.success_rates(paired_rows, [candidate]).join(paired_rows.groupBy(candidate).agg(F.avg("activated").alias("tar"), F.sum("trigger").cast("double").alias("k")), candidate)
    tests = paired.permutation_test(paired_rows, [candidate], permutations, alpha=alpha).select(candidate, "p_value")
    adjusted = adjust(tests.where("p_value is not null"), "bh", alpha, name=candidate).select(candidate, "adjusted_p", F.col("significant").alias("after_fdr"))
    low, high = clopper_pearson_lower("k", F.col("n").cast("double")), clopper_pearson_upper("k", F.col("n").cast("double"))
    out = rates.join(tests, candidate).join(adjusted, candidate, "left").withColumns({"low": low, "high": high})
    tsr = F.col("tsr") if target else F.lit(None).cast("double")
    gap = F.when(F.lit(target) & (F.col("n") >= 10), F.col("separation"))
    out = out.withColumn("result", paired.taxonomy(F.col("n"), F.col("tar"), tsr, gap, F.col("adjusted_p")))
    gates = paired.promotion(out.select(F.col(candidate).alias("candidate_hash"), "tar", tsr.alias("tsr"), gap.alias("separation"), "n"), promote).select(F.col("candidate_hash").alias(candidate), "status", "rank")
    return out.withColumn("significant", F.coalesce("after_fdr", F.lit(False))).select(candidate, "n", "tar", tsr.alias("tsr"), "tsr_shuffled", "tsr_noise", "control", "envelope", gap.alias("separation"), "low", "high", "p_value", "adjusted_p", "significant", "result").join(gates, candidate)
