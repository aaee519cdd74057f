"""Streams: windows over event time, idempotent intake, and stateful checks of sequences.

run_available() drives a stream over what is there now and gives its final state as a table; the same transformations serve an endless
source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.types import IntegerType, StringType, StructField, StructType, TimestampType

from ..functions.shared import fresh_path


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files at path, with their schema."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_time(df: DataFrame, time: str, lateness: str = "10 minutes") -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], value: str, start: str = "0 seconds") -> DataFrame:
    w = F.window(time, size, size, start)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, time: str, size: str, step: str, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(F.window(time, size, step).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str]) -> DataFrame:
    return df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def deduplicate(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark: intake that may deliver twice."""
    return df.dropDuplicatesWithinWatermark(keys)


class _Sequences(StatefulProcessor):
    """A key's counters and last number in one value state, its nonces in a map state: a lookup reads one nonce, not all of them."""

    def __init__(self, key: str, sequence: str, nonce: str, window_ms: int | None) -> None:
        self.key, self.sequence, self.nonce, self.window_ms = key, sequence, nonce, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "n long, gaps long, back long, replayed long, last long, unknown long")
        self.seen = handle.getMapState("seen", "nonce string", "n int", self.window_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, gaps, back, replayed, last, unknown = self.counters.get() if self.counters.exists() else (0, 0, 0, 0, -1, 0)
        # a frame at a time, in the batch's order; a record without a number or a nonce is counted apart
        for frame in rows:
            known = frame[self.sequence].notna() & frame[self.nonce].notna()
            n, unknown = n + len(frame), unknown + int((~known).sum())
            records = frame[known].sort_values([self.sequence, self.nonce], kind="stable")
            for s, x in zip(records[self.sequence], records[self.nonce], strict=True):
                if last >= 0:
                    gaps += int(s > last + 1)
                    back += int(s <= last)
                if self.seen.containsKey((x,)):
                    replayed += 1
                else:
                    self.seen.updateValue((x,), (1,))
                last = max(last, int(s))
        self.counters.update((n, gaps, back, replayed, last, unknown))
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "n_gaps": [gaps], "n_back": [back], "n_replayed": [replayed], "n_unknown": [unknown]})

    def close(self) -> None:
        pass


def sequence_check(df: DataFrame, key: str, sequence: str, nonce: str, replay_window_ms: int | None = None) -> DataFrame:
    """key, n, n_gaps, n_back, n_replayed, n_unknown of a key's records so far: gaps and steps back in the sequence, repeated nonces, records without either.
    A batch's frames are taken one by one, each in the order of its numbers; a batch with more rows of a key than Arrow puts in a frame should come sorted. Nonces live in RocksDB, on disk
    where they don't fit; with replay_window_ms each is forgotten so long after it was first seen, which bounds the state of an endless source."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = f"{key} {dict(df.dtypes)[key]}, n long, n_gaps long, n_back long, n_replayed long, n_unknown long"
    mode = "None" if replay_window_ms is None else "ProcessingTime"
    return df.groupBy(key).transformWithStateInPandas(_Sequences(key, sequence, nonce, replay_window_ms), out, "Update", mode)


def accounting(folder: str, raw: str, parsed: Column, lateness_s: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every row of a stream goes into one of two tables, accepted or dead, the latter with its reason: MISSING_TIME, INVALID_TIME, or
    TOO_LATE, which is more than lateness_s before the newest time of all earlier batches. A batch is written once with its verdicts, and its newest time
    and counts come from what was written, so that a repeated batch overwrites itself and counts the same. The engine's own watermark
    drops late rows without a trace; here intake = accepted + dead."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = _counts(spark, folder).where(F.col("batch") < number).agg(F.max("newest").alias("newest"))  # one row a batch
        text = F.col(raw).cast("string")
        late = F.unix_micros("at") < F.unix_micros("newest") - lateness_s * 1_000_000
        reason = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "MISSING_TIME").when(F.col("at").isNull(), "INVALID_TIME").when(late, "TOO_LATE")
        marked = batch.withColumn("at", parsed).crossJoin(F.broadcast(newest)).withColumn("reason", reason).drop("newest")
        marked.withColumn("dead", F.col("reason").isNotNull().cast("int")).write.mode("overwrite").partitionBy("dead").parquet(f"{folder}/rows/batch={number}")
        counts = spark.read.parquet(f"{folder}/rows/batch={number}").groupBy("reason").agg(F.count("*").alias("n"), F.max("at").alias("newest"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")  # at most four rows

    return run


_COUNTS = "reason string, n long, newest timestamp, batch int"


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(_COUNTS).parquet(f"{folder}/counts")
    except AnalysisException:  # before the first batch
        return spark.createDataFrame([], _COUNTS)


def run_accounted(stream: DataFrame, raw: str, parsed: Column, lateness_s: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """accepted and dead rows (with at, the time as read; the dead with their reason) of everything available, and the counts: batch, reason, n."""
    spark = stream.sparkSession
    folder = fresh_path(spark, "intake")
    stream.writeStream.foreachBatch(accounting(folder, raw, parsed, lateness_s)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("at", TimestampType()), StructField("reason", StringType()), StructField("batch", IntegerType()), StructField("dead", IntegerType())])
    counts = _counts(spark, folder).select("batch", "reason", "n")
    if not counts.limit(1).count():
        none = spark.createDataFrame([], schema)
        return none.drop("reason", "batch", "dead"), none.drop("batch", "dead"), counts
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    return rows.where("dead = 0").drop("reason", "batch", "dead"), rows.where("dead = 1").drop("batch", "dead"), counts


def run_available(stream: DataFrame, mode: str, latest_by: list[str] | None = None) -> DataFrame:
    """The result table after everything available was read. Complete mode: the last batch's table; update mode: each key's last row; append:
    all rows. Batches are written into the shared folder, under their number, so that a repeated batch overwrites itself."""
    spark = stream.sparkSession
    folder = fresh_path(spark, "stream")
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        rows = spark.read.option("recursiveFileLookup", "true").schema(StructType([*schema.fields, StructField("__batch", IntegerType())])).parquet(f"{folder}/out")
    except Exception as e:  # no batch ran: the source was empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        last = rows.agg(F.max("__batch").alias("__last"))
        return rows.join(F.broadcast(last), F.col("__batch") == F.col("__last")).drop("__batch", "__last")
    if latest_by:
        others = [c for c in rows.columns if c not in (*latest_by, "__batch")]
        return rows.groupBy(*latest_by).agg(F.max_by(F.struct(*others), "__batch").alias("x")).select(*latest_by, "x.*")
    return rows.drop("__batch")
