"""Two-sample drift. Populations come as one long table: is_target (boolean), feature, value; or is_target, label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import materialize
from ..functions.special import chi_square_p
from ..functions.stats import clamp, dual_gate, ks_p_value
from .multiple_testing import adjust
from .ordered import carried, quantiles, ranges_for, running

EPSILON = 1e-6


def melt(df: DataFrame, is_target: Column, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long form of the features; rows for which is_target is null belong to neither population."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features)))
    long = df.select(*keys, is_target.alias("is_target"), pairs.alias("x")).where("is_target is not null")
    return long.select(*keys, "is_target", "x.feature", "x.value").where("value is not null and not isnan(value) and abs(value) < double('inf')")


def class_counts(df: DataFrame, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """keys, label, ref_count, target_count: the full outer join of both populations' counts as one aggregation. A table of such counts passes as it is."""
    if {"ref_count", "target_count"} <= set(df.columns):
        return df
    ref, target = (~F.col("is_target")).cast("long"), F.col("is_target").cast("long")
    return df.groupBy(*keys, F.col(label).cast("string").alias("label")).agg(F.sum(ref).alias("ref_count"), F.sum(target).alias("target_count"))


def categorical(df: DataFrame, label: str = "label", keys: Sequence[str] = (), level: float = 0.05, tvd_at: float = 0.05, jsd_at: float = 0.02) -> DataFrame:
    """One row a key: TVD, JSD (bits), smoothed chi-square goodness of fit, unseen and missing classes, dual gate."""
    counts = class_counts(df, label, keys)
    total = counts.groupBy(*keys).agg(F.sum("ref_count").alias("n_ref"), F.sum("target_count").alias("n_target"), F.count("*").alias("__k"))
    c = counts.join(total, list(keys)) if keys else counts.crossJoin(F.broadcast(total))  # one row
    p, q = F.col("ref_count") / F.col("n_ref"), F.col("target_count") / F.col("n_target")
    m = (p + q) / 2
    kl = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    expected = F.col("n_target") * (F.col("ref_count") + EPSILON) / (F.col("n_ref") + F.col("__k") * EPSILON)
    out = c.groupBy(*keys, "n_ref", "n_target", "__k").agg(
        clamp(F.sum(F.abs(p - q)) / 2).alias("tvd"), clamp(F.sum(kl(p) + kl(q)) / 2).alias("jsd"),
        F.sum((F.col("target_count") - expected) ** 2 / expected).alias("__chi2"),
        F.array_sort(F.collect_list(F.when((F.col("ref_count") == 0) & (F.col("target_count") > 0), F.col("label")))).alias("unseen"),
        F.array_sort(F.collect_list(F.when((F.col("ref_count") > 0) & (F.col("target_count") == 0), F.col("label")))).alias("missing"),
    )
    one = F.col("__k") <= 1
    out = out.withColumn("chi_square", F.when(one, 0.0).otherwise(F.col("__chi2"))).withColumn("df", F.greatest(F.lit(1), F.col("__k") - 1).cast("int"))
    out = out.withColumn("p_value", F.when(one, 1.0).otherwise(chi_square_p("chi_square", "df")))
    significant, practical = F.col("p_value") <= level, (F.col("tvd") >= tvd_at) | (F.col("jsd") >= jsd_at) | (F.size("unseen") > 0)
    return out.withColumn("status", dual_gate(significant, practical)).drop("__chi2", "__k")


def feature_impact(status: Column, effect: Column) -> Column:
    """Operational impact of a numeric feature's shift."""
    return F.when(status == "MATERIAL_SHIFT", F.when(effect >= 0.25, "HIGH").otherwise("MEDIUM")).when(status == "SIGNIFICANT_SHIFT", "LOW").when(status == "SHIFT_DETECTED", "MEDIUM").otherwise("NEGLIGIBLE")


def label_impact(status: Column, tvd: Column, n_unseen: Column) -> Column:
    """Operational impact of a shift of classes; classes that the reference lacks weigh most."""
    known = F.when(status == "MATERIAL_SHIFT", F.when(tvd >= 0.20, "HIGH").otherwise("MEDIUM")).when(status == "SIGNIFICANT_SHIFT", "LOW").when(status == "SHIFT_DETECTED", "MEDIUM").otherwise("NEGLIGIBLE")
    return F.when(n_unseen >= 3, "CRITICAL").when(n_unseen > 0, "HIGH").otherwise(known)


def label_profile(df: DataFrame, label: str = "label", keys: Sequence[str] = (), imbalanced_at: float = 10.0) -> DataFrame:
    """categorical, and of the target's classes: n_classes, imbalance_ratio (its most frequent class to its rarest; null with fewer than two), imbalanced, impact. Rows are counted once.
    A key that is null or has no reference or no target is a row with the status INSUFFICIENT_DATA and no statistics; a null label is a class, which names leave out."""
    counts = materialize(class_counts(df.where("is_target is not null"), label, keys), "classes")
    seen = F.when(F.col("target_count") > 0, F.col("target_count"))
    sizes = counts.groupBy(*keys).agg(F.sum("ref_count").alias("n_ref"), F.sum("target_count").alias("n_target"), F.count(seen).alias("n_classes"), F.max(seen).alias("__most"), F.min(seen).alias("__least")).where("n_ref + n_target > 0")
    both = counts.join(sizes.where("n_ref > 0 and n_target > 0").select(*keys), list(keys), "left_semi") if keys else counts.join(F.broadcast(sizes.where("n_ref > 0 and n_target > 0").select("n_ref").withColumnRenamed("n_ref", "__n")), how="left_semi")
    found = categorical(both, keys=keys)
    out = sizes.join(found.drop("n_ref", "n_target"), list(keys), "left") if keys else sizes.join(F.broadcast(found.drop("n_ref", "n_target")), how="left")  # one row each
    share = F.col("__least") / F.greatest(F.col("n_target"), F.lit(1))
    ratio = F.when(F.col("n_classes") > 1, F.when(share > 1e-6, F.col("__most") / F.col("__least")).otherwise(100.0))
    out = out.withColumn("imbalance_ratio", ratio).withColumn("imbalanced", F.coalesce(ratio >= imbalanced_at, F.lit(False)))
    out = out.withColumn("status", F.coalesce("status", F.lit("INSUFFICIENT_DATA")))
    return out.withColumn("impact", label_impact(F.col("status"), F.col("tvd"), F.coalesce(F.size("unseen"), F.lit(0)))).drop("__most", "__least")


def pooled(df: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """keys, value, r, t: how often either population has each finite value, added up before the shuffle. A table that has r and t passes as
    it is, so that a caller counts once for all statistics."""
    if {"r", "t"} <= set(df.columns):
        return df
    ref, target = (~F.col("is_target")).cast("long"), F.col("is_target").cast("long")
    v = F.col("value").cast("double")
    finite = df.where(F.col("is_target").isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return finite.groupBy(*keys, v.alias("value")).agg(F.sum(ref).alias("r"), F.sum(target).alias("t"))


def ks(df: DataFrame, keys: Sequence[str] = ("feature",), ranges: int | None = None) -> DataFrame:
    """keys, n_ref, n_target, ks, p_value: one pass over the distinct pooled values. df: rows or counts (pooled)."""
    ranges = ranges_for(df, keys) if ranges is None else ranges
    values = pooled(df, keys)
    cumulated = running(values, keys, "value", {"cr": F.col("r"), "ct": F.col("t")}, ranges)
    sizes = values.groupBy(*keys).agg(F.sum("r").alias("n_ref"), F.sum("t").alias("n_target"), F.count("*").alias("__distinct"))
    gap = F.abs(F.col("cr") / F.col("n_ref") - F.col("ct") / F.col("n_target"))
    out = cumulated.join(sizes.where("n_ref > 0 and n_target > 0"), list(keys)).groupBy(*keys, "n_ref", "n_target", "__distinct").agg(clamp(F.max(gap)).alias("ks"))
    # two constant populations: equal (one distinct value) or apart (two, each of one population)
    p = F.when((F.col("__distinct") == 1) & (F.col("ks") == 0), 1.0).when((F.col("__distinct") == 2) & (F.col("ks") == 1), 0.0).otherwise(ks_p_value(F.col("ks"), F.col("n_ref").cast("double"), F.col("n_target").cast("double")))
    return out.withColumn("p_value", p).drop("__distinct")


def psi(df: DataFrame, keys: Sequence[str] = ("feature",), bins: int = 10, ranges: int | None = None) -> DataFrame:
    """keys, psi, bins: reference quantiles as edges (distinct ones), open ends, smoothed shares. A constant reference gives 0 or 1.
    Edges and bins both come from the counts of distinct values (df: rows or counts)."""
    ranges = ranges_for(df, keys) if ranges is None else ranges
    values = pooled(df, keys)
    if ranges > 1:
        values = materialize(values, "pooled")  # brackets read it a few times
    edges = quantiles(values.where("r > 0"), keys, "value", {f"e{i}": i / bins for i in range(bins + 1)}, ranges, weight="r")
    edges = edges.select(*keys, F.array_sort(F.array_distinct(F.array(*(f"e{i}" for i in range(bins + 1))))).alias("edges"))
    inner = F.slice(F.col("edges"), 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    placed = values.join(edges.withColumn("inner", inner), list(keys)).withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("value"))))
    same = F.abs(F.col("value") - F.col("edges")[0]) <= 1e-8 + 1e-5 * F.abs(F.col("edges")[0])
    counts = placed.groupBy(*keys, "bin", F.size("edges").alias("n_edges")).agg(F.sum("r").alias("r"), F.sum("t").alias("t"), F.min((F.col("t") == 0) | same).alias("same"))
    every = edges.select(*keys, F.size("edges").alias("n_edges"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"))
    full = every.join(counts, [*keys, "n_edges", "bin"], "left")
    total = counts.groupBy(*keys).agg(F.sum("r").alias("n_ref"), F.sum("t").alias("n_target"))
    k = F.greatest(F.col("n_edges") - 1, F.lit(1))
    p = (F.coalesce("r", F.lit(0)) + EPSILON) / (F.col("n_ref") + k * EPSILON)
    q = (F.coalesce("t", F.lit(0)) + EPSILON) / (F.col("n_target") + k * EPSILON)
    out = full.join(total, list(keys)).groupBy(*keys, "n_edges").agg(F.greatest(F.lit(0.0), F.sum((q - p) * F.log(q / p))).alias("x"), F.min("same").alias("same"))
    value = F.when(F.col("n_edges") < 2, F.when(F.col("same"), 0.0).otherwise(1.0)).otherwise(F.col("x"))
    return out.select(*keys, value.alias("psi"), F.greatest(F.col("n_edges") - 1, F.lit(1)).alias("bins"))


def _pieces(values: DataFrame, keys: Sequence[str], grid: int, ranges: int) -> DataFrame:
    """keys, g, is_target, x (first, last, y, slope): either population's quantile function as straight stretches of the grid points 0 to g - 1.

    A distinct value is one level stretch; the slope that leads up to it from the value before is another. Stretches without a point are left out."""
    sizes = values.groupBy(*keys).agg(F.sum("r").alias("n_ref"), F.sum("t").alias("n_target")).where("n_ref > 0 and n_target > 0")
    g = F.when(F.col("n_ref") == F.col("n_target"), F.col("n_ref")).otherwise(F.greatest(F.lit(grid).cast("long"), "n_ref", "n_target"))
    sides = F.explode(F.array(*(F.struct(F.lit(t).alias("is_target"), F.col(c).alias("c")) for t, c in ((False, "r"), (True, "t")))))
    own = values.select(*keys, "value", sides.alias("s")).select(*keys, "value", "s.*").where("c > 0")
    of = [*keys, "is_target"]
    own = carried(running(own, of, "value", {"below": F.col("c")}, ranges), of, "value", {"prior": F.col("value")}, ranges, with_own=False)
    own = own.join(sizes.withColumn("g", g), list(keys)).withColumn("n", F.when(F.col("is_target"), F.col("n_target")).otherwise(F.col("n_ref")))
    steps, points = F.greatest(F.col("n") - 1, F.lit(1)), F.col("g") - 1

    def div(at: Column, more: Column) -> Column:
        """(at * points + more) div steps: in longs where the product fits one, else in decimals, which are slow."""
        wide = lambda c: c.cast("decimal(19,0)")
        long = F.call_function("div", at * points + more, steps)
        return F.when(F.col("g") < 3_000_000_000, long).otherwise(F.call_function("div", wide(at) * wide(points) + wide(more), wide(steps)))

    floor = lambda at: div(at, F.lit(0).cast("long"))  # noqa: E731 the last point at or before a place
    ceil = lambda at: div(at, steps - 1)
    start, end, rise = F.col("below") - F.col("c"), F.col("below") - 1, F.col("value") - F.col("prior")
    level = F.struct(ceil(start).alias("first"), F.when(F.col("n") == 1, points).otherwise(floor(end)).alias("last"), F.col("value").alias("y"), F.lit(0.0).alias("slope"))
    up = floor(start - 1) + 1
    pace = (F.col("n") - 1) / F.greatest(points, F.lit(1))  # places a point
    gone = up * pace - (start - 1)
    slope = F.struct(up.alias("first"), (ceil(start) - 1).alias("last"), (F.col("prior") + rise * gone).alias("y"), (rise * pace).alias("slope"))
    both = F.when(F.col("prior").isNull(), F.array(level)).otherwise(F.array(slope, level))
    return own.select(*keys, "g", "is_target", F.explode(both).alias("x")).where("x.first <= x.last")


def wasserstein(df: DataFrame, keys: Sequence[str] = ("feature",), grid: int = 2000, ranges: int | None = None) -> DataFrame:
    """keys, w1: with equal sizes the mean gap of order statistics, else of quantiles on a grid of max(grid, sizes) points.

    Between neighbouring steps of the two quantile functions both are straight, so that each stretch of points is added up in closed form: the work
    follows the distinct values, not the rows or points (df: rows or counts)."""
    ranges = ranges_for(df, keys) if ranges is None else ranges
    pieces = _pieces(pooled(df, keys), keys, grid, ranges)
    # a stretch of one population meets the other's latest; where both begin at a point, the earlier row's stretch has no points
    starts = pieces.withColumns({"i": F.col("x.first"), "at": F.col("x.first") * 2 + F.col("is_target").cast("int")})
    met = carried(starts, keys, "at", {"p": F.when(~F.col("is_target"), F.col("x")), "q": F.when(F.col("is_target"), F.col("x"))}, ranges)
    at = lambda x: F.col(f"{x}.y") + F.col(f"{x}.slope") * (F.col("i") - F.col(f"{x}.first"))
    met = met.select(*keys, "g", (F.least("p.last", "q.last") - F.col("i") + 1).alias("n"), (at("p") - at("q")).alias("d"), (F.col("p.slope") - F.col("q.slope")).alias("s")).where("n > 0")
    d, s, n = F.col("d"), F.col("s"), F.col("n")
    end = d + s * (n - 1)
    turn = F.least(n - 1, F.floor(F.abs(d / F.when(s != 0, s))) + 1)  # so many points lie before the lines cross
    crossed = turn * F.abs(2 * d + s * (turn - 1)) / 2 + (n - turn) * F.abs(d + s * turn + end) / 2
    gap = F.when(d * end < 0, crossed).otherwise(n * F.abs(d + end) / 2)
    return met.groupBy(*keys, "g").agg(F.sum(gap).alias("__gap")).select(*keys, (F.col("__gap") / F.col("g")).alias("w1"))


def spread(counts: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """keys, std: the reference's standard deviation (of a population), about its mean."""
    mean = counts.groupBy(*keys).agg((F.sum(F.col("value") * F.col("r")) / F.sum("r")).alias("mean"), F.sum("r").alias("n"))
    apart = counts.join(mean.where("n > 0"), list(keys))
    return apart.groupBy(*keys).agg(F.sqrt(F.sum(F.col("r") * (F.col("value") - F.col("mean")) ** 2) / F.max("n")).alias("std"))


def features(long: DataFrame, level: float = 0.05, psi_at: float = 0.10, w1_at: float = 0.10, method: str = "bh", ranges: int | None = None) -> DataFrame:
    """The drift engine over numeric features: KS with a correction over the family, PSI and standardized W1 as effect sizes, dual gate."""
    counts = materialize(pooled(long), "features")  # four statistics read it, some of them twice
    ranges = ranges_for(counts, ["feature"]) if ranges is None else ranges
    out = ks(counts, ranges=ranges).join(psi(counts, ranges=ranges), "feature").join(wasserstein(counts, ranges=ranges), "feature").join(spread(counts), "feature")
    out = out.withColumn("w1_std", F.when(F.col("std") > 1e-12, F.col("w1") / F.col("std")).otherwise(F.col("w1"))).drop("std")
    out = adjust(out, method, level, name="feature")
    return out.withColumn("status", dual_gate(F.col("significant"), (F.col("psi") >= psi_at) | (F.col("w1_std") >= w1_at)))
