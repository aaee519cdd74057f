"""Choosing and naming populations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_population(df: DataFrame, ids: Sequence[str] = (), contributors: Sequence[str] = (), start: str | None = None, end: str | None = None, classes: Sequence[str] = (), id_col: str = "sample_id", contributor_col: str = "contributor", time_col: str = "time", class_col: str = "class") -> DataFrame:
    """All conditions hold that are given. Times are compared as strings, both ends included; rows without a time or a class pass those two."""
    out = df
    if ids:
        out = out.where(F.col(id_col).isin(list(ids)))
    if contributors:
        out = out.where(F.col(contributor_col).isin(list(contributors)))
    if start is not None:
        out = out.where(F.col(time_col).isNull() | (F.col(time_col) >= start))
    if end is not None:
        out = out.where(F.col(time_col).isNull() | (F.col(time_col) <= end))
    if classes:
        out = out.where(F.col(class_col).isNull() | F.col(class_col).isin(list(classes)))
    return out


def _rank(id_col: str, salt: str) -> Column:
    return F.sha2(F.concat_ws(":", F.col(id_col), F.lit(salt)), 256)


def hash_ranked(df: DataFrame, id_col: str, n: int, salt: str, keys: Sequence[str] = ()) -> DataFrame:
    """The n distinct ids (of each group) with the least sha256(id:salt). Without groups it is a distributed top-n."""
    ids = df.select(*keys, id_col).distinct()
    if not keys:
        return ids.orderBy(_rank(id_col, salt), id_col).limit(n)
    # the n least of each task first, so that a hot group isn't ranked in one task
    ids = ids.withColumn("__h", _rank(id_col, salt)).withColumn("__part", F.pmod(F.xxhash64(id_col), F.lit(64)))
    inner = Window.partitionBy(*keys, "__part").orderBy("__h", id_col)
    outer = Window.partitionBy(*keys).orderBy("__h", id_col)
    first = ids.withColumn("__r", F.row_number().over(inner)).where(F.col("__r") <= n)
    return first.withColumn("__r", F.row_number().over(outer)).where(F.col("__r") <= n).select(*keys, id_col)


def identity(df: DataFrame, id_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, digest: SHA-256 over the sorted distinct ids, a line each. The digest of one string needs the ids of a group together; for
    groups beyond memory take set_identity."""
    ids = df.select(*keys, id_col).distinct()
    return ids.groupBy(*keys).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(id_col)), "\n"), 256).alias("digest"))


def set_identity(df: DataFrame, id_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, digest: an order-free name of a set of any size, from sums of its ids' hashes (partial sums meet, nothing is gathered)."""
    ids = df.select(*keys, id_col).distinct().withColumn("__h", F.sha2(F.col(id_col).cast("string"), 256))
    parts = [F.sum(F.conv(F.substring("__h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"__{i}") for i in range(4)]
    return ids.groupBy(*keys).agg(F.count("*").alias("n"), *parts).select(*keys, "n", F.sha2(F.concat_ws(":", *(F.col(f"__{i}").cast("string") for i in range(4)), F.col("n").cast("string")), 256).alias("digest"))


def boundary(df: DataFrame, keys: Sequence[str] = (), least: int = 30) -> DataFrame:
    """keys, n_ref, n_target, status of comparing two populations (is_target)."""
    counts = df.groupBy(*keys).agg(F.sum((~F.col("is_target")).cast("long")).alias("n_ref"), F.sum(F.col("is_target").cast("long")).alias("n_target"))
    small = F.least("n_ref", "n_target")
    return counts.withColumn("status", F.when(small == 0, "EMPTY_POPULATION").when(small < least, "INSUFFICIENT_DATA").otherwise("READY"))


def schema_compatibility(reference: DataFrame, target: DataFrame) -> DataFrame:
    """One row a column name: its types on both sides and whether they agree, are only on one side, or differ."""
    spark = reference.sparkSession
    ref, tgt = dict(reference.dtypes), dict(target.dtypes)
    rows = [(c, ref.get(c), tgt.get(c), "MISSING_IN_TARGET" if c not in tgt else "ADDED_IN_TARGET" if c not in ref else "COMPATIBLE" if ref[c] == tgt[c] else "TYPE_MISMATCH") for c in sorted({*ref, *tgt})]
    return spark.createDataFrame(rows, "name string, reference_type string, target_type string, status string")
