"""Drift over time. Windows start at the first event, half open; index 0 is the first. No window or sample is capped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialize
from ..functions.stats import dual_gate
from . import drift
from .multiple_testing import adjust
from .ordered import ranges_for


def normalize_time(column: str):
    """UTC ISO time with microseconds of ISO strings, epoch seconds and two further formats (no zone: UTC); null if none fits."""
    text = F.trim(F.col(column).cast("string"))
    epoch = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_micros((text.cast("double") * 1e6).cast("long")))
    tried = [F.try_to_timestamp(F.when(~text.rlike(r"^-?\d+(\.\d+)?$"), F.regexp_replace(text, "Z$", "+00:00")))] + [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy/MM/dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss")]
    return F.date_format(F.coalesce(epoch, *tried), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def assign_windows(df: DataFrame, time: str, size_s: float, step_s: float | None = None) -> DataFrame:
    """df with window_index, a row for each window that it lies in. A sliding step is at least half the size."""
    step = size_s if step_s is None else max(step_s, size_s / 2)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    first = df.agg(F.min(micros).alias("__first"))
    out = df.where(F.col(time).isNotNull()).crossJoin(F.broadcast(first))  # one row
    at = (micros - F.col("__first")) / 1e6
    last = F.floor(at / step)
    if step == size_s:
        out = out.withColumn("window_index", last)
    else:
        low = F.greatest(F.lit(0), F.floor((at - size_s) / step) + 1)
        out = out.withColumn("window_index", F.explode(F.sequence(low, last)))
    return out.withColumn("window_start", F.timestamp_micros((F.col("__first") + F.col("window_index") * int(step * 1e6)).cast("long")).cast("timestamp_ntz")).drop("__first")


def describe_windows(windowed: DataFrame, least: int = 30) -> DataFrame:
    return windowed.groupBy("window_index", "window_start").agg(F.count("*").alias("n")).withColumn("valid", F.col("n") >= least)


def comparisons(windowed: DataFrame, value: str, kind: str = "baseline", baseline: int = 0, least: int = 30, level: float = 0.05) -> DataFrame:
    """A row for each compared window (target): against the baseline window, or (kind adjacent) against the one before it.
    KS, PSI and standardized W1; Benjamini-Hochberg over the family."""
    valid = describe_windows(windowed, least).where("valid").select("window_index")
    rows = windowed.join(F.broadcast(valid), "window_index") if kind == "adjacent" else windowed.join(F.broadcast(valid), "window_index").union(windowed.where(F.col("window_index") == baseline).join(F.broadcast(valid), "window_index", "left_anti").select("window_index", *[c for c in windowed.columns if c != "window_index"]))
    rows = rows.select("window_index", F.col(value).cast("double").alias("value"))
    own = rows.groupBy("window_index", "value").agg(F.count("*").alias("c"))  # windows meet as counts of distinct values, not as rows
    no = F.lit(0).cast("long")
    if kind == "adjacent":
        both = own.select(F.col("window_index").alias("target"), "value", no.alias("r"), F.col("c").alias("t")).union(own.select(F.col("window_index") + 1, "value", "c", no))
        known = valid.select(F.col("window_index").alias("target")).join(valid.select((F.col("window_index") + 1).alias("target")), "target")
    else:
        known = valid.where(F.col("window_index") != baseline).select(F.col("window_index").alias("target"))
        targets = known.agg(F.sort_array(F.collect_set("target")).alias("all"))
        base = own.where(F.col("window_index") == baseline).crossJoin(F.broadcast(targets))  # one row, a number a window
        base = base.select(F.explode("all").alias("target"), "value", F.col("c").alias("r"), no.alias("t"))
        both = own.where(F.col("window_index") != baseline).select(F.col("window_index").alias("target"), "value", no.alias("r"), F.col("c").alias("t")).union(base)
    finite = both.where("value is not null and not isnan(value) and abs(value) < double('inf')").join(known, "target")
    counts = materialize(finite.groupBy("target", "value").agg(F.sum("r").alias("r"), F.sum("t").alias("t")), "windows")  # four statistics read it, some of them twice
    ranges = ranges_for(counts, ["target"])
    out = drift.ks(counts, ["target"], ranges).join(drift.psi(counts, ["target"], ranges=ranges), "target").join(drift.wasserstein(counts, ["target"], ranges=ranges), "target").join(drift.spread(counts, ["target"]), "target")
    out = out.withColumn("w1_std", F.when(F.col("std") > 1e-12, F.col("w1") / F.col("std")).otherwise(F.col("w1"))).drop("std")
    out = adjust(out, "bh", level, name="target")
    practical = (F.col("psi") >= 0.10) | (F.col("w1_std") >= 0.10)
    return out.withColumn("status", F.when(F.col("significant"), dual_gate(F.lit(True), practical)).otherwise("NO_SHIFT_DETECTED"))


def change_points(adjacent: DataFrame) -> DataFrame:
    """Every adjacent pair with a material shift, with a confidence by its p-value."""
    return adjacent.where("status = 'MATERIAL_SHIFT'").select("target", F.col("psi").alias("discrepancy"), "adjusted_p", F.when(F.col("adjusted_p") <= 0.01, 0.90).otherwise(0.80).alias("confidence"))


def trajectory(baseline: DataFrame, adjacent: DataFrame) -> DataFrame:
    """One row: the state of the series. Windows are few, so these windows over them are small."""
    w = Window.orderBy("target")
    b = baseline.withColumn("shift", F.col("status") == "MATERIAL_SHIFT").withColumn("rises", F.col("psi") > F.lag("psi").over(w))
    shifted = b.where("shift").withColumn("next", F.lag("target").over(w) + 1 == F.col("target"))
    facts = b.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("shift").cast("long")), F.lit(0)).alias("shifts"), F.coalesce(F.min("rises"), F.lit(True)).alias("rising"))
    facts = facts.crossJoin(F.broadcast(shifted.agg(F.coalesce(F.max("next"), F.lit(False)).alias("consecutive"))))
    facts = facts.crossJoin(F.broadcast(adjacent.agg(F.coalesce(F.max(F.col("psi") >= 0.06), F.lit(False)).alias("abrupt"))))
    state = F.when(F.col("shifts") == 0, "NO_MATERIAL_SHIFT").when(F.col("shifts") == 1, "TRANSIENT_SHIFT").when((F.col("n") >= 3) & F.col("rising"), "GRADUAL_DRIFT").when(F.col("abrupt"), "ABRUPT_SHIFT").when(F.col("consecutive"), "PERSISTENT_SHIFT").otherwise("TRANSIENT_SHIFT")
    return facts.select("n", "shifts", state.alias("trajectory"))
