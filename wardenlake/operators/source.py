"""Drift by source: canonical names, eligible groups, each group against a reference group."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.shared import materialize
from ..functions.stats import dual_gate
from . import drift
from .ordered import ranges_for
from .multiple_testing import adjust


def canonical_name(raw: str | None) -> str:
    """NFKC, printable characters, single spaces, lower case, at most 128 characters; missing if nothing is left."""
    kept = "".join(c for c in unicodedata.normalize("NFKC", raw or "") if c.isprintable() or c.isspace())
    return re.sub(r"\s+", " ", kept).strip().lower()[:128] or "missing"


@F.pandas_udf(StringType())
def _canonical(raw: pd.Series) -> pd.Series:
    return raw.map(canonical_name)


def canonicalize(df: DataFrame, source: str) -> DataFrame:
    """df with canonical_source. Only the distinct names go through Python: SQL has no NFKC."""
    names = df.select(F.col(source).alias("__raw")).distinct().select("__raw", _canonical("__raw").alias("canonical_source"))
    return df.join(names, F.col(source).eqNullSafe(F.col("__raw"))).drop("__raw")


def pseudonym(project: str, name: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(project + salt), name), 256), 1, 16)


def groups(df: DataFrame, source: str = "canonical_source", least: int = 30) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n")).withColumn("eligible", F.col("n") >= least)


def fragmentation(df: DataFrame, source: str = "canonical_source", least: int = 30, limit: float = 0.20) -> DataFrame:
    """One row: how many observations lie in groups below the threshold, and whether that is excessive."""
    g = groups(df, source, least)
    out = g.agg(F.count("*").alias("n_groups"), F.sum((~F.col("eligible")).cast("long")).alias("n_small_groups"), F.sum("n").alias("n"), F.sum(F.when(~F.col("eligible"), F.col("n")).otherwise(0)).alias("n_small"))
    share = F.coalesce(F.try_divide("n_small", "n"), F.lit(0.0))
    return out.withColumn("small_share", share).withColumn("excessive", share > limit)


def against_reference(df: DataFrame, value: str, label: str, source: str = "canonical_source", reference: str | None = None, least: int = 30, level: float = 0.05, confounded_at: float = 0.15) -> DataFrame:
    """Each eligible group against the reference group (the first by name unless named): KS, PSI, label TVD, BH over the family, rank."""
    eligible = groups(df, source, least).where("eligible")
    if reference is None:
        reference_name = eligible.agg(F.min(source).alias("__ref"))
    else:
        reference_name = eligible.where(F.col(source) == reference).select(F.col(source).alias("__ref"))
    own = df.join(eligible.select(source, "n"), source).crossJoin(F.broadcast(reference_name))  # one row
    targets = eligible.select(F.col(source).alias("target"), F.col("n").alias("n_group"))
    others = targets.join(reference_name.withColumnRenamed("__ref", "target"), "target", "left_anti").select("target")
    no = F.lit(0).cast("long")

    def counted(column: str, kind: str, name: str) -> DataFrame:
        """target, name, r, t: the reference's counts meet every other group, which is a small table, as counts and not as rows."""
        c = own.groupBy(source, "__ref", F.col(column).cast(kind).alias(name)).agg(F.count("*").alias("c"))
        base = c.where(F.col(source) == F.col("__ref")).select(name, F.col("c").alias("r")).crossJoin(others).select("target", name, "r", no.alias("t"))
        mine = c.where(F.col(source) != F.col("__ref")).select(F.col(source).alias("target"), name, no.alias("r"), F.col("c").alias("t"))
        return mine.union(base).groupBy("target", name).agg(F.sum("r").alias("r"), F.sum("t").alias("t"))

    labels = counted(label, "string", "label")
    totals = labels.groupBy("target").agg(F.sum("r").alias("nr"), F.sum("t").alias("nt"))
    tvd = labels.join(totals, "target").groupBy("target").agg((F.sum(F.abs(F.col("r") / F.col("nr") - F.col("t") / F.col("nt"))) / 2).alias("label_tvd"))
    counts = materialize(counted(value, "double", "value").where("value is not null and not isnan(value) and abs(value) < double('inf')"), "sources")
    ranges = ranges_for(counts, ["target"])  # a hot source is many tasks
    out = drift.ks(counts, ["target"], ranges).join(drift.psi(counts, ["target"], ranges=ranges), "target").join(tvd, "target")
    out = adjust(out, "bh", level, name="target")
    out = out.withColumn("status", F.when(F.col("significant"), dual_gate(F.lit(True), F.col("psi") >= 0.10)).otherwise("NO_SHIFT_DETECTED")).withColumn("confounded", F.col("label_tvd") >= confounded_at)
    order = F.when(F.col("status") == "MATERIAL_SHIFT", 3).when(F.col("status") == "SIGNIFICANT_SHIFT", 2).otherwise(1)
    return out.withColumn("place", F.row_number().over(Window.orderBy(order.desc(), F.round("psi", 6).desc(), F.round("adjusted_p", 6), F.col("n_target").desc(), "target")))
