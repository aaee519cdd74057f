"""Corrections of p-values, a family at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp

METHODS = ("bh", "holm", "bonferroni", "none")


def adjust(df: DataFrame, method: str = "bh", level: float = 0.05, p: str = "p_value", name: str = "name", family: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """df with rank, adjusted_p, significant and critical. Ties in p go by name. strict: significance below the level, not at it."""
    whole, by = Window.partitionBy(*family), Window.partitionBy(*family).orderBy(p, name)
    out = df.withColumn("rank", F.row_number().over(by).cast("long")).withColumn("__k", F.count("*").over(whole))
    raw = clamp(F.col(p))
    if method == "bh":
        out = out.withColumn("__raw", raw * (F.col("__k") / F.col("rank")))
        back = Window.partitionBy(*family).orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
        adjusted, critical = clamp(F.min("__raw").over(back)), F.col("rank") / F.col("__k") * level
    elif method == "holm":
        out = out.withColumn("__raw", F.least(F.lit(1.0), raw * (F.col("__k") - F.col("rank") + 1)))
        ahead = Window.partitionBy(*family).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        adjusted, critical = clamp(F.max("__raw").over(ahead)), level / (F.col("__k") - F.col("rank") + 1)
    elif method == "bonferroni":
        adjusted, critical = F.least(F.lit(1.0), F.col(p) * F.col("__k")), level / F.col("__k")
    elif method == "none":
        adjusted, critical = F.col(p), F.lit(level)
    else:
        raise ValueError(f"method must be one of {METHODS}")
    out = out.withColumn("adjusted_p", adjusted).withColumn("critical", critical.cast("double"))
    if method in ("bonferroni", "none"):
        out = out.withColumn("rank", F.lit(1).cast("long"))
    return out.withColumn("significant", F.col("adjusted_p") < level if strict else F.col("adjusted_p") <= level).drop("__k", *(["__raw"] if "__raw" in out.columns else []))
