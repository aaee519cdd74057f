"""Mutation lab: deterministic damage to tables, to show that a detector sees it and leaves the undamaged twin alone.

Which rows are hit is decided by a hash of the row's key and a seed, so a mutation is a projection or filter: no row moves and reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen(key: str, share: float, seed: int) -> Column:
    """About share of the rows, by hash."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)


def flip_labels(df: DataFrame, key: str, label: str, classes: int, share: float = 0.2, seed: int = 42) -> DataFrame:
    """The label moves on by one class."""
    return df.withColumn(label, F.when(chosen(key, share, seed), (F.col(label) + 1) % classes).otherwise(F.col(label)))


def target_label(df: DataFrame, key: str, label: str, source: int, target: int, share: float = 0.5, seed: int = 42) -> DataFrame:
    return df.withColumn(label, F.when((F.col(label) == source) & chosen(key, share, seed), F.lit(target)).otherwise(F.col(label)))


def shift_feature(df: DataFrame, column: str, by: float) -> DataFrame:
    return df.withColumn(column, F.col(column) + by)


def scale_feature(df: DataFrame, column: str, factor: float) -> DataFrame:
    return df.withColumn(column, F.col(column) * factor)


def duplicate_rows(df: DataFrame, key: str, new_key: Column, share: float = 0.1, seed: int = 42) -> DataFrame:
    return df.union(df.where(chosen(key, share, seed)).withColumn(key, new_key).select(*df.columns))


def drop_rows(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    return df.where(~chosen(key, share, seed))


def reassign_contributor(df: DataFrame, key: str, column: str, contributor: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    return df.withColumn(column, F.when(chosen(key, share, seed), F.lit(contributor)).otherwise(F.col(column)))


def stamp_trigger(df: DataFrame, key: str, vector: str, places: int = 4, value: float = 1.0, share: float = 0.1, seed: int = 42) -> DataFrame:
    """The first places components of chosen vectors become one value."""
    stamped = F.transform(vector, lambda x, i: F.when(i < places, F.lit(value).cast("float")).otherwise(x))
    return df.withColumn(vector, F.when(chosen(key, share, seed), stamped).otherwise(F.col(vector)))


def alter_content(df: DataFrame, key: str, column: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    return df.withColumn(column, F.when(chosen(key, share, seed), F.concat(column, F.lit("~"))).otherwise(F.col(column)))


def shift_time(df: DataFrame, key: str, column: str, seconds: int, share: float = 0.05, seed: int = 42) -> DataFrame:
    return df.withColumn(column, F.when(chosen(key, share, seed), F.timestamp_seconds(F.unix_timestamp(F.col(column).cast("timestamp")) + seconds).cast(dict(df.dtypes)[column])).otherwise(F.col(column)))


def outcome(clean: Column, damaged: Column) -> Column:
    """The paired verdict of a detector: seen only on the damaged twin is what is wanted."""
    return F.when(damaged & ~clean, "DETECTED").when(damaged & clean, "FALSE_POSITIVE").when(~damaged & clean, "INVERTED").otherwise("MISSED")
