"""Drift of representations: embeddings of a reference and a target, for many models at once.

Rows are keys (model), is_target, a vector column. A null vector or, under L2, one of no length is a failed extraction; one of another dimension or with a value that isn't finite is
invalid. Both are counted and take no part; rows with a null is_target belong to neither side. Null keys are keys like others; equal vectors count as often as they occur; an empty
table gives no rows; other columns are ignored. Random features and projections are drawn from the seed, but sides are permuted by rows' places, so that p-values vary with these.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.shared import materialize
from ..functions.stats import dual_gate
from .ordered import carried, join_groups, ranges_for, running
from .vectors import _mix

# Severity and confidence of a finding by status.
SEVERITY = {"MATERIAL_SHIFT": "high", "SIGNIFICANT_SHIFT": "medium", "SHIFT_DETECTED": "low"}
CONFIDENCE = {"MATERIAL_SHIFT": 0.95, "SIGNIFICANT_SHIFT": 0.85, "SHIFT_DETECTED": 0.75}


def _state(vector: str, dimension: int, normalize: bool) -> Column:
    """valid, failed or invalid."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    long = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) > 1e-24
    return F.when(v.isNull(), "failed").when((F.size(v) != dimension) | ~finite, "invalid").when(F.lit(normalize) & ~long, "failed").otherwise("valid")


def representation_accounting(df: DataFrame, keys: Sequence[str], vector: str, dimension: int, normalize: bool = True) -> DataFrame:
    """keys and, of both sides, the number of rows, of valid, failed and invalid ones; and all_valid. One aggregation."""
    state = _state(vector, dimension, normalize)
    rows = df.where("is_target is not null").select(*keys, "is_target", state.alias("state"))
    count = lambda own, s: F.sum((own & (F.col("state") == s if s else F.lit(True))).cast("long"))
    sides = (("reference", ~F.col("is_target")), ("target", F.col("is_target")))
    return rows.groupBy(*keys).agg(*(count(own, s).alias(f"{n}_{s or 'total'}") for n, own in sides for s in (None, "valid", "failed", "invalid")))


def _widths(rows: DataFrame, sides: DataFrame, keys: Sequence[str], sample: int) -> DataFrame:
    """keys, gamma: 1 / (2 * median positive squared distance) of at most sample rows a side, those of the least hashes: a documented bound, the statistics take all rows. Rows are
    thinned by hash to about four times that first, so that no side is sorted whole."""
    own = F.when(F.col("is_target"), F.col("target_valid")).otherwise(F.col("reference_valid"))
    thin = join_groups(rows, sides, keys).withColumn("h", F.xxhash64("v", "is_target", "place")).where(F.col("h").cast("double") < -(2.0**63) + 2.0**64 * F.least(F.lit(1.0), 4.0 * sample / own))
    least = thin.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "is_target").orderBy("h", "place"))).where(F.col("i") <= sample)

    def width(f: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(f["v"].to_numpy())
        d2 = np.maximum(0.0, (z * z).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2 * z @ z.T)[np.triu_indices(len(z), 1)]
        d2 = d2[d2 > 1e-12]
        return f.iloc[:1][[*keys]].assign(gamma=float(np.clip(1 / (2 * np.median(d2)), 1e-6, 1e6)) if len(d2) else 1.0)

    schema = StructType([*(least.schema[k] for k in keys), StructField("gamma", DoubleType())])
    return least.select(*keys, "v").groupBy(*keys).applyInPandas(width, schema)  # at most 2 * sample rows a group


def _mmd(rows: DataFrame, facts: DataFrame, keys: Sequence[str], features: int, permutations: int, seed: int) -> DataFrame:
    """keys, mmd2, error, p_value from random Fourier features: tasks add up features numbers a side and permutation for each key they meet, in one pass."""
    fields = [rows.schema[k] for k in keys]

    def sums(frames):
        for f in frames:
            for _, g in f.groupby("group", sort=False):
                v = np.stack(g["v"].to_numpy())
                t = np.random.default_rng(seed).standard_normal((features, v.shape[1])) * np.sqrt(2 * float(g["gamma"].iloc[0]))
                p = v @ t.T
                z = np.hstack([np.cos(p), np.sin(p), np.ones((len(v), 1))])
                n, m = int(g["reference_valid"].iloc[0]), int(g["target_valid"].iloc[0])
                draws = _mix(np.arange(1, permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
                places = _mix(g["place"].to_numpy().astype(np.int64).view(np.uint64))
                drawn = _mix(places[:, None] ^ draws[None, :]) >= np.uint64(min(int(n / (n + m) * 2**64), 2**64 - 1))
                own = np.hstack([g["is_target"].to_numpy().astype(bool)[:, None], drawn])
                right = own.T.astype(float) @ z
                total = np.stack([z.sum(0)[None, :] - right, right])
                head = {k: [g[k].iloc[0]] * (2 * total.shape[1]) for k in keys}
                yield pd.DataFrame({**head, "side": np.repeat([0, 1], total.shape[1]), "k": np.tile(np.arange(total.shape[1]), 2), "z": [row.tolist() for row in total.reshape(-1, total.shape[2])]})

    def compared(f: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.sum(np.stack(f.loc[f["side"] == side, "z"].to_numpy()), 0) for side in (0, 1))
        gap = (a / max(a[-1], 1) - b / max(b[-1], 1))[:-1] ** 2
        each = gap[:features] + gap[features:]
        return f.iloc[:1][[*keys, "k"]].assign(mmd2=float(each.mean()), error=float(each.std() / math.sqrt(features)))

    met = join_groups(rows, facts.select(*keys, "gamma", "reference_valid", "target_valid", F.xxhash64(F.to_json(F.struct(*keys))).alias("group") if keys else F.lit(0).alias("group")), keys)
    parts = met.mapInPandas(sums, StructType([*fields, StructField("side", IntegerType()), StructField("k", IntegerType()), StructField("z", ArrayType(DoubleType()))]))
    each = parts.groupBy(*keys, "k").applyInPandas(compared, StructType([*fields, StructField("k", IntegerType()), StructField("mmd2", DoubleType()), StructField("error", DoubleType())]))  # a row a batch in each group
    seen = lambda c: F.max(F.when(F.col("k") == 0, F.col(c)))
    out = each.groupBy(*keys).agg(seen("mmd2").alias("mmd2"), seen("error").alias("error"), F.collect_list(F.when(F.col("k") > 0, F.col("mmd2"))).alias("others"))  # a number a permutation
    return out.select(*keys, "mmd2", "error", ((1 + F.size(F.filter("others", lambda s: s >= F.col("mmd2") - 1e-12))) / (1 + permutations)).alias("p_value"))


def _energy(rows: DataFrame, facts: DataFrame, keys: Sequence[str], dimension: int, directions: int, seed: int) -> DataFrame:
    """keys, energy: the energy distance by sorted random projections, counts of equal places added up before the shuffle."""
    scale = math.exp(math.lgamma((dimension + 1) / 2) - math.lgamma(dimension / 2)) * math.sqrt(math.pi)
    drawn = np.random.default_rng(seed).standard_normal((directions, dimension))
    drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()) @ drawn.T))

    met = join_groups(rows, facts.select(*keys, "reference_valid", "target_valid"), keys)
    gap = F.when(F.col("is_target"), -1 / F.col("target_valid")).otherwise(1 / F.col("reference_valid"))
    values = met.select(*keys, gap.alias("gap"), F.posexplode(project("v")).alias("direction", "at")).groupBy(*keys, "direction", "at").agg(F.sum("gap").alias("gap"))
    values, by = materialize(values, "projections"), [*keys, "direction"]
    ranges = ranges_for(values, by)
    steps = carried(running(values, by, "at", {"apart": F.col("gap")}, ranges), by, "at", {"before": F.struct("at", "apart")}, ranges, with_own=False)
    each = steps.groupBy(*by).agg(F.coalesce(2 * F.sum(F.pow("before.apart", F.lit(2.0)) * (F.col("at") - F.col("before.at"))), F.lit(0.0)).alias("e"))
    return each.groupBy(*keys).agg((F.avg("e") * scale).alias("energy"))


def representation_drift(df: DataFrame, keys: Sequence[str], vector: str, dimension: int, normalize: bool = True, least: int = 30, level: float = 0.05, mmd_at: float = 0.02, energy_at: float = 1.0,
                         features: int = 512, permutations: int = 100, directions: int = 32, sample: int = 500, seed: int = 42) -> DataFrame:
    """One row a key: the accounting, gamma, mmd2 with its standard error, p_value by permutation, energy, status (significance by p_value, practice by mmd2 or energy), severity and confidence
    of the finding. A key with fewer than least valid rows on either side is INSUFFICIENT_DATA, without statistics. All work is linear in the rows but for sorted projections; no key is
    one task's, and the valid vectors are written once, with the places by which permutations draw."""
    sides = materialize(representation_accounting(df, keys, vector, dimension, normalize), "accounting")
    enough = (F.col("reference_valid") >= least) & (F.col("target_valid") >= least)
    x = F.transform(vector, lambda a: a.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))
    rows = df.where(F.col("is_target").isNotNull() & (_state(vector, dimension, normalize) == "valid")).select(*keys, "is_target", x.alias("v"))
    rows = rows.withColumn("v", F.transform("v", lambda a: a / norm)) if normalize else rows
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "vectors")
    valid = sides.where(enough)
    facts = materialize(join_groups(valid, _widths(rows, valid, keys, sample), keys), "widths")
    found = join_groups(_mmd(rows, facts, keys, features, permutations, seed), _energy(rows, facts, keys, dimension, directions, seed), keys)
    out = join_groups(sides, join_groups(facts.select(*keys, "gamma"), found, keys), keys, "left") if keys else sides.join(F.broadcast(facts.select("gamma").crossJoin(found)), how="left")  # one row each
    status = F.when(enough, dual_gate(F.col("p_value") <= level, (F.col("mmd2") >= mmd_at) | (F.col("energy") >= energy_at))).otherwise("INSUFFICIENT_DATA")
    pick = lambda values, other: F.coalesce(*(F.when(F.col("status") == s, F.lit(x)) for s, x in values.items()), F.lit(other))
    return out.withColumn("status", status).withColumn("severity", pick(SEVERITY, "info")).withColumn("confidence", pick(CONFIDENCE, 0.99))
