"""Running totals, ranks and exact quantiles that don't put a whole group into one task.

A window over a group of few keys and many rows is one task a key. Here each group is first cut into ranges at approximate quantiles; totals
of the ranges (a few rows a key) give each range its offset, and windows run within the ranges. The approximation only balances the
ranges: results are exact. With ranges=1 it is the plain window, right for many small groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialize

ROWS_A_RANGE = 1_000_000
#: A counting pass cuts a bracket at CELLS - 1 approximate quantiles, searched in strides of STRIDE.
CELLS, STRIDE = 256, 16


def ranges_for(df: DataFrame, keys: Sequence[str]) -> int:
    """So many ranges that the largest group has about ROWS_A_RANGE rows in each."""
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return min(4096, -(-largest // ROWS_A_RANGE) or 1)


def join_groups(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on the keys of groups, in which null is a key like others."""
    if not keys:
        return df.crossJoin(F.broadcast(other))  # the one group's few rows
    named = other.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in other.columns if c not in keys))
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], how).drop(*(f"__k{i}" for i in range(len(keys))))


def _ranged(df: DataFrame, keys: Sequence[str], order: str, ranges: int) -> DataFrame:
    at = [i / ranges for i in range(1, ranges)]
    splits = df.groupBy(*keys).agg(F.percentile_approx(order, at, 1000).alias("__splits"))
    out = join_groups(df, splits, keys)
    return out.withColumn("__range", F.size(F.filter("__splits", lambda s: s < F.col(order)))).drop("__splits")


def _offsets(df: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    part = df.groupBy(*keys, "__range").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return part.select(*keys, "__range", *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))


def running(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """df with a running total for each of sums, up to and with the rows that tie in order."""
    ranges = ranges_for(df, keys) if ranges is None else ranges
    if ranges <= 1:
        w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    cut = _ranged(df, keys, order, ranges)
    w = Window.partitionBy(*keys, "__range").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    out = join_groups(cut, _offsets(cut, keys, sums), [*keys, "__range"])
    return out.withColumns({n: F.sum(c).over(w) + F.col(f"__{n}") for n, c in sums.items()}).drop("__range", *(f"__{n}" for n in sums))


def ranked(df: DataFrame, keys: Sequence[str], order: str, name: str = "rank", ranges: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """df with a place from 0 in each group by order (and ties)."""
    ranges = ranges_for(df, keys) if ranges is None else ranges
    if ranges <= 1:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties)).cast("long") - 1)
    cut = _ranged(df, keys, order, ranges)
    w = Window.partitionBy(*keys, "__range").orderBy(order, *ties)
    out = join_groups(cut, _offsets(cut, keys, {"n": F.lit(1)}), [*keys, "__range"])
    return out.withColumn(name, F.row_number().over(w) + F.col("__n") - 1).drop("__range", "__n")


def carried(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, Column], ranges: int | None = None, with_own: bool = True) -> DataFrame:
    """df with, for each of columns, its last value that isn't null in the rows before (with_own: or in the row itself). No two rows tie."""
    ranges = ranges_for(df, keys) if ranges is None else ranges
    until = 0 if with_own else -1
    if ranges <= 1:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, until)
        return df.withColumns({n: F.last(c, ignorenulls=True).over(w) for n, c in columns.items()})
    cut = _ranged(df, keys, order, ranges)
    lasts = cut.groupBy(*keys, "__range").agg(*(F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(f"__{n}") for n, c in columns.items()))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(*keys, "__range", *(F.last(f"__{n}", ignorenulls=True).over(before).alias(f"__{n}") for n in columns))
    w = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, until)
    out = join_groups(cut, lasts, [*keys, "__range"])
    return out.withColumns({n: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"__{n}")) for n, c in columns.items()}).drop("__range", *(f"__{n}" for n in columns))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, ranges: int | None = None, weight: str | None = None) -> DataFrame:
    """keys, value, c, below (how many are at most value) for the finite values: one row a distinct value. A row counts weight times."""
    ranges = ranges_for(df, keys) if ranges is None else ranges
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return running(finite.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("c")), keys, value, {"below": F.col("c")}, ranges)


def _cells(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """keys, __rank0 (weight in the cells before), __c (weight in this one), __rows, __lo, __hi (its least and greatest value). Borders are approximate quantiles, which are values
    themselves: each is a cell of its own and the values between two are one, so that a value of many rows never shares a cell. Only counts of cells are shuffled."""
    at = [i / CELLS for i in range(1, CELLS)]
    splits = rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx("__v", at, 1000))).alias("__splits"))
    splits = splits.withColumn("__coarse", F.filter("__splits", lambda x, i: i % STRIDE == STRIDE - 1))
    less = lambda c: F.size(F.filter(c, lambda x: x < F.col("__v")))
    met = join_groups(rows, splits, keys).withColumn("__skip", less("__coarse") * STRIDE)
    met = met.withColumn("__less", F.col("__skip") + less(F.slice("__splits", F.col("__skip") + 1, F.lit(STRIDE))))
    own = F.coalesce(F.get("__splits", F.col("__less")) == F.col("__v"), F.lit(False)).cast("int")
    cells = met.groupBy(*keys, (F.col("__less") * 2 + own).alias("__cell")).agg(F.sum("__w").alias("__c"), F.count("*").alias("__rows"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * CELLS rows a key
    return materialize(cells.withColumn("__rank0", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__cell"), name)


def bracketed(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], weight: str | None = None, few: int = ROWS_A_RANGE) -> DataFrame:
    """quantiles for large groups, without a sort of all distinct values. Each pass reads df, counts the cells of the brackets that hold the wanted order statistics, and leaves of each
    bracket the one cell that holds it (under a hundredth of its rows), until none has over few rows; the values of these are counted and ranked. Exact: borders only balance
    the cells, places come from counts. Passes run when the plan is built; the driver reads one number a pass. df must give the same rows each time."""
    v = F.col(value)
    finite = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = finite.select(*keys, v.alias("__v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("__w")).where("__w > 0")
    cells = _cells(rows, keys, "cells")
    n = cells.groupBy(*keys).agg(F.sum("__c").alias("n"))
    places = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in probabilities.items()}
    wanted = F.array_distinct(F.array(*(f(x).cast("long") for x in places.values() for f in (F.floor, F.ceil))))
    found = join_groups(cells, n.withColumn("__rank", F.explode(wanted)), keys).where("__rank0 <= __rank and __rank < __rank0 + __c").select(*keys, "n", "__rank", "__rank0", "__rows", "__lo", "__hi")
    while (found.where("__lo < __hi").agg(F.max("__rows")).first()[0] or 0) > few:
        inner = _cells(_within(rows, found.where("__lo < __hi"), keys), [*keys, "__at"], "cells").withColumnsRenamed({"__rank0": "__skipped", "__lo": "__lo2", "__hi": "__hi2", "__rows": "__rows2"})
        narrow = join_groups(found.where("__lo < __hi").withColumn("__at", F.col("__lo")), inner, [*keys, "__at"]).withColumn("__rank0", F.col("__rank0") + F.col("__skipped"))
        narrow = narrow.where("__rank0 <= __rank and __rank < __rank0 + __c").select(*keys, "n", "__rank", "__rank0", F.col("__rows2").alias("__rows"), F.col("__lo2").alias("__lo"), F.col("__hi2").alias("__hi"))
        found = materialize(found.where("__lo = __hi").unionByName(narrow), "brackets")
    open_ = found.where("__lo < __hi")
    counts = _within(rows, open_, keys).groupBy(*keys, "__at", "__v").agg(F.sum("__w").alias("__c"))
    counts = counts.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*keys, "__at").orderBy("__v")))  # at most few rows a bracket
    got = join_groups(open_.withColumn("__at", F.col("__lo")), counts, [*keys, "__at"]).withColumn("__upto", F.col("__upto") + F.col("__rank0"))
    got = got.where("__upto - __c <= __rank and __rank < __upto").select(*keys, "n", "__rank", "__v")
    every = found.where("__lo = __hi").select(*keys, "n", "__rank", F.col("__lo").alias("__v")).unionByName(got)
    at = lambda x, f: F.max(F.when(F.col("__rank") == f(x).cast("long"), F.col("__v")))
    wide = every.groupBy(*keys, "n").agg(*(a for name, x in places.items() for a in (at(x, F.floor).alias(f"__lo_{name}"), at(x, F.ceil).alias(f"__hi_{name}"))))
    return wide.select(*keys, "n", *((F.col(f"__lo_{m}") + (F.col(f"__hi_{m}") - F.col(f"__lo_{m}")) * (x - F.floor(x))).alias(m) for m, x in places.items()))


def _within(rows: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that lie in a bracket (__lo to __hi) of their key, with its __lo as __at. A key has two brackets a quantile at most, and no two overlap."""
    each = brackets.select(*keys, F.col("__lo").alias("__at"), F.col("__hi").alias("__until")).distinct()
    return join_groups(rows, each, keys).where("__at <= __v and __v <= __until").drop("__until")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], ranges: int | None = None, weight: str | None = None) -> DataFrame:
    """keys, n and, for each name, the exact quantile with linear interpolation: by ranks of the distinct values, or where groups are large (ranges above 1) by brackets."""
    ranges = ranges_for(df, keys) if ranges is None else ranges
    if ranges > 1:
        return bracketed(df, keys, value, probabilities, weight)
    counts = value_counts(df, keys, value, ranges, weight)
    sizes = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    both = join_groups(counts, sizes, keys)
    aggs = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("n") - 1)
        aggs += [F.min(F.when(F.col("below") > F.floor(place), F.col(value))).alias(f"__lo_{name}"), F.min(F.when(F.col("below") > F.ceil(place), F.col(value))).alias(f"__hi_{name}")]
    got = both.groupBy(*keys, "n").agg(*aggs)
    frac = lambda p: F.lit(float(p)) * (F.col("n") - 1) - F.floor(F.lit(float(p)) * (F.col("n") - 1))
    return got.select(*keys, "n", *((F.col(f"__lo_{m}") + (F.col(f"__hi_{m}") - F.col(f"__lo_{m}")) * frac(p)).alias(m) for m, p in probabilities.items()))


def median_mad(df: DataFrame, keys: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """keys, n, median, mad (median absolute deviation, unscaled) over the finite values."""
    ranges = ranges_for(df, keys) if ranges is None else ranges
    middle = quantiles(df, keys, value, {"median": 0.5}, ranges)
    known = middle.select(*keys, "median")
    apart = join_groups(df, known, keys)
    mad = quantiles(apart.withColumn("__apart", F.abs(F.col(value) - F.col("median"))), keys, "__apart", {"mad": 0.5}, ranges)
    return join_groups(middle, mad.select(*keys, "mad"), keys)
