"""Tables in the folder that all machines share, to cut the lineage of iterations. All of a session's lie below one folder, which goes when the session's JVM ends."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FILE_ROWS = 8192  # of narrow rows; a local store starts a process or more for each file that it creates


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder of our own, but only if the master is this very process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_own_shared_dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = spark.sparkContext._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="shared_")
    return found.rstrip("/")


def on_store(spark: SparkSession, path: str):
    """The file system that holds a path, and the path, for what must be done once and not by tasks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def run_folder(spark: SparkSession) -> str:
    """This session's folder below the shared one; the file system deletes it when the JVM ends."""
    folder = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_run_folder", None) != folder:
        fs, path = on_store(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        spark.sparkContext._run_folder = folder
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: df written as Parquet below the shared folder and read again, so that lost executors cost no recomputation.
    rows: about how many there are, if known; narrow rows are then dealt to a file for FILE_ROWS, not one for each partition, however few they are."""
    path = fresh_path(df.sparkSession, name)
    if rows is not None:
        most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(min(most, max(1, -(-rows // FILE_ROWS))))
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these, once nothing reads it any more."""
    for df in tables:
        fs, path = on_store(df.sparkSession, df._written_to)
        fs.delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all of the session's tables. Results that aren't written yet read them: write those first."""
    fs, path = on_store(spark, run_folder(spark))
    fs.delete(path, True)
    fs.mkdirs(path)


def kept(spark: SparkSession) -> list[str]:
    """The names of the session's tables that are still there."""
    fs, path = on_store(spark, run_folder(spark))
    return sorted(s.getPath().getName() for s in fs.listStatus(path))
