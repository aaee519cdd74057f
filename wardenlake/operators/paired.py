"""Paired experiments: success rates by condition, sign-flip permutations, promotion, localization, taxonomy."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .multiple_testing import adjust


def success_rates(paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, tsr, tsr_shuffled, tsr_noise, control, separation, envelope of rows (trigger, shuffled, noise in {0, 1})."""
    out = paired.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("trigger").alias("tsr"), F.avg("shuffled").alias("tsr_shuffled"), F.avg("noise").alias("tsr_noise"), F.avg(F.greatest("shuffled", "noise")).alias("envelope"))
    return out.withColumn("control", F.greatest("tsr_shuffled", "tsr_noise")).withColumn("separation", F.col("tsr") - F.col("control"))


def pair_conditions(observations: DataFrame, sample: str = "sample_id", condition: str = "condition", success: str = "success", keys: Sequence[str] = ()) -> DataFrame:
    """One row a sample with its success under trigger, shuffled and noise; samples that lack one of them go."""
    out = observations.groupBy(*keys, sample).pivot(condition, ["trigger", "shuffled", "noise"]).agg(F.max(F.col(success).cast("int")))
    return out.where("trigger is not null and shuffled is not null and noise is not null")


def seed_of(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "big")


def permutation_test(paired: DataFrame, keys: Sequence[str], permutations: int = 1000, tag: str = "experiment", alpha: float = 0.05) -> DataFrame:
    """keys, n, p_value (the greater of two controls'), significant; null below ten pairs.

    A pair's sign flips only matter through its differences, so a group is reduced to nine counts of (trigger - shuffled, trigger - noise); for a
    permutation the number of kept signs in each is binomial. So no group is gathered, whatever its size."""
    counts = paired.groupBy(*keys, (F.col("trigger") - F.col("shuffled")).alias("ds"), (F.col("trigger") - F.col("noise")).alias("dn")).agg(F.count("*").alias("pairs"))
    names = list(keys)
    kinds = dict(paired.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ds", "dn"])
        ds, dn, c = (pdf[x].to_numpy(np.int64) for x in ("ds", "dn", "pairs"))
        n = int(c.sum())
        row = {k: [pdf[k].iloc[0]] for k in names} | {"n": [n]}
        if n < 10:
            return pd.DataFrame(row | {"p_value": [None], "separation": [None]})
        rng = np.random.Generator(np.random.PCG64(seed_of(tag, *(pdf[k].iloc[0] for k in names))))
        net = 2 * rng.binomial(c, 0.5, (permutations, len(c))) - c  # sum of the signs in each class of pairs
        p = [(1 + int(((net @ d) / n >= (d * c).sum() / n - 1e-12).sum())) / (permutations + 1) for d in (ds, dn)]
        return pd.DataFrame(row | {"p_value": [max(p)], "separation": [min((ds * c).sum(), (dn * c).sum()) / n]})

    out = counts.groupBy(*names).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in names) + ", n long, p_value double, separation double")
    return out.withColumn("significant", F.coalesce((F.col("p_value") < alpha) & (F.col("separation") > 0), F.lit(False)))


def promotion(candidates: DataFrame, most: int = 2, tar_at: float = 0.5, tsr_at: float = 0.5, separation_at: float = 0.2) -> DataFrame:
    """candidates (candidate_hash, tar, tsr, separation, n) with status and, of the eligible, rank."""
    gate = (
        F.when(F.col("n") < 10, "INSUFFICIENT_SUPPORT").when(F.col("tsr").isNull(), "NOT_APPLICABLE_NO_TARGET").when(F.coalesce("tar", F.lit(-1.0)) < tar_at, "NOT_PROMOTED_LOW_TAR")
        .when(F.col("tsr") < tsr_at, "NOT_PROMOTED_LOW_TSR").when(F.coalesce("separation", F.lit(-1.0)) <= separation_at, "NOT_PROMOTED_LOW_SEPARATION")
    )
    out = candidates.withColumn("gate", gate)
    order = Window.partitionBy(F.col("gate").isNull()).orderBy(F.col("separation").desc(), F.col("tsr").desc(), F.col("tar").desc(), "candidate_hash")
    rank = F.when(F.col("gate").isNull(), F.row_number().over(order))
    out = out.withColumn("rank", rank)
    return out.withColumn("status", F.coalesce("gate", F.when(F.col("rank") <= most, "PROMOTED").otherwise("NOT_PROMOTED_RANK_EXCEEDED"))).drop("gate")


def localize(cells: DataFrame, alpha: float = 0.05) -> DataFrame:
    """cells (cell_index, n, p_value, separation) with Holm's correction over those with a p-value, grid row and column (8 x 8)."""
    tested = adjust(cells.where("p_value is not null"), "holm", alpha, name="cell_index", strict=True).select("cell_index", "adjusted_p", "significant")
    out = cells.drop("significant").join(tested, "cell_index", "left")
    return out.withColumn("grid_row", F.floor(F.col("cell_index") / 8).cast("int")).withColumn("grid_col", (F.col("cell_index") % 8).cast("int"))


def taxonomy(n: Column, tar: Column, tsr: Column, separation: Column, p: Column) -> Column:
    strong = (n >= 100) & (tsr >= 0.90) & (separation >= 0.60) & (p < 0.001)
    targeted = (n >= 30) & (tar.isNull() | (tar >= 0.70)) & (tsr >= 0.70) & (separation >= 0.40) & (p < 0.05)
    untargeted = F.when((tar >= 0.70) & (p < 0.05), "TRIGGER_CANDIDATE_OBSERVED").otherwise("NO_TRIGGER_EVIDENCE")
    return (
        F.when(n < 10, "INSUFFICIENT_SUPPORT").when(tsr.isNull(), untargeted).when(separation.isNull() | p.isNull(), "NO_TRIGGER_EVIDENCE").when(strong, "STRONG_TRIGGER_CONSISTENCY")
        .when(targeted, "TARGETED_EFFECT_DETECTED").when((p < 0.05) & (separation > 0), "TRIGGER_CANDIDATE_OBSERVED").when((tar > 0) & (separation <= 0), "NORMAL_SENSITIVITY_ONLY").otherwise("NO_TRIGGER_EVIDENCE")
    )


def suite_rates(results: DataFrame) -> DataFrame:
    """detection_rate, false_negative_rate, false_positive_rate of rows (attack, detected)."""
    a, d = F.col("attack"), F.col("detected")
    rate = lambda hit, of: F.coalesce(F.avg(F.when(of, hit.cast("double"))), F.lit(0.0))
    return results.agg(rate(d, a).alias("detection_rate"), rate(~d, a).alias("false_negative_rate"), rate(d, ~a).alias("false_positive_rate"))
