"""A catalogue of append-only tables: several are written together, all or nothing, and content that is there already isn't written again.

Tables are Parquet folders below a root. A write has two phases. First Spark writes each table's new rows into a folder of this attempt; its own commit
protocol keeps failed and repeated tasks out. Then one manifest, numbered one above the last and created only if no other has that number, names
the attempt's folders: from then on readers see all of them. Without a manifest nothing of an attempt is ever read. If another writer took the number, this one looks
again at what is new and tries the next.

Rows have content_hash (of all columns but the id) and sequence, which counts on from the last commit without gaps: places come from counts of ranges
(`ordered.ranked`), not from one task. Equal content within a write is kept once, with the least id. Readers read the manifests (a few lines a commit) and then
only the folders that they name."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.shared import discard, materialize, on_store
from ..operators.ordered import ranked

_MANIFEST = "number long, attempt string, name string, rows long, tables int"


class Conflict(RuntimeError):
    """Other writers took the next number again and again."""


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """number, attempt, name, rows, tables of every whole manifest."""
    fs, path = on_store(spark, f"{root}/manifests")
    if not fs.exists(path) or not len(fs.listStatus(path)):
        return spark.createDataFrame([], _MANIFEST)
    found = spark.read.schema(_MANIFEST).json(f"{root}/manifests")
    whole = found.groupBy("number").agg(F.count("*").alias("n"), F.max("tables").alias("of")).where("n = of").select("number")
    return found.join(F.broadcast(whole), "number")  # one row a commit


def read(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The committed rows of a table; None before its first commit."""
    attempts = [r["attempt"] for r in manifests(spark, root).where(F.col("name") == name).orderBy("number").select("attempt").collect()]  # one row a commit
    return spark.read.parquet(*(f"{root}/data/{name}/attempt={a}" for a in attempts)) if attempts else None


def _new_rows(df: DataFrame, key: str, there: DataFrame | None) -> DataFrame:
    content = [c for c in sorted(df.columns) if c != key]
    rows = df.withColumn("content_hash", F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256))
    if there is not None:
        rows = rows.join(there.select("content_hash"), "content_hash", "left_anti")
    least = rows.groupBy("content_hash").agg(F.min(key).alias("__least"))  # map-side: a hot content is one row a task
    return rows.join(least, "content_hash").where(F.col(key).eqNullSafe(F.col("__least"))).drop("__least").dropDuplicates(["content_hash"])


def write(root: str, tables: dict[str, tuple[DataFrame, str]], tries: int = 20) -> dict[str, int]:
    """Commit the new rows of tables (name: rows and their id column) together; how many each got. Rows that are there already are passed over, so that a
    repeated write changes nothing."""
    spark = next(iter(tables.values()))[0].sparkSession
    root = root.rstrip("/")
    for _ in range(tries):
        known = manifests(spark, root).groupBy("name").agg(F.max("number").alias("number"), F.sum("rows").alias("rows")).collect()  # one row a table
        number = max((r["number"] for r in known), default=-1) + 1
        held = {r["name"]: r["rows"] for r in known}
        attempt, got, made = uuid.uuid4().hex, {}, []
        for name, (df, key) in tables.items():
            new = materialize(_new_rows(df, key, read(spark, root, name)), "catalog_new")
            made.append(new)
            got[name] = new.count()
            if got[name]:
                place = F.conv(F.substring("content_hash", 1, 12), 16, 10).cast("double")
                placed = ranked(new.withColumn("__k", place), [], "__k", "sequence", ties=["content_hash"]).drop("__k")
                placed.withColumn("sequence", F.col("sequence") + held.get(name, 0)).write.parquet(f"{root}/data/{name}/attempt={attempt}")
        discard(*made)
        if not any(got.values()) or _commit(spark, root, number, attempt, {n: k for n, k in got.items() if k}):
            return got
    raise Conflict(f"no number was free in {tries} tries")


def _commit(spark: SparkSession, root: str, number: int, attempt: str, rows: dict[str, int]) -> bool:
    """Create the manifest of this number; False if there is one."""
    fs, path = on_store(spark, f"{root}/manifests/{number:012d}.json")
    lines = "".join(json.dumps({"number": number, "attempt": attempt, "name": n, "rows": k, "tables": len(rows)}) + "\n" for n, k in rows.items())
    try:
        out = fs.create(path, False)
    except Exception as e:
        if "already exists" in str(e) or "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(lines.encode()))
    out.close()
    return True


def vacuum(spark: SparkSession, root: str, keep: Sequence[str] = ()) -> int:
    """Delete the folders of attempts that no manifest names (and that aren't in keep, those still under way); how many."""
    named = {(r["name"], r["attempt"]) for r in manifests(spark, root).select("name", "attempt").collect()}  # one row a commit
    fs, path = on_store(spark, f"{root}/data")
    gone = 0
    for table in fs.listStatus(path) if fs.exists(path) else ():
        for folder in fs.listStatus(table.getPath()):
            attempt = folder.getPath().getName().partition("=")[2]
            if (table.getPath().getName(), attempt) not in named and attempt not in keep:
                fs.delete(folder.getPath(), True)
                gone += 1
    return gone


class ProgressTable(StreamingQueryListener):
    """Progress of streams as rows of an append-only table: query, batch, rows in, rows a second, watermark. A row a batch, written as it ends."""

    SCHEMA = "query string, batch long, at string, rows_in long, rows_per_second double, watermark string, event string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _put(self, *row) -> None:
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def onQueryStarted(self, event) -> None:
        self._put(str(event.id), None, event.timestamp, None, None, None, "STARTED")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._put(str(p.id), p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond), dict(p.eventTime).get("watermark"), "PROGRESS")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._put(str(event.id), None, None, None, None, None, "FAILED" if event.exception else "ENDED")


def progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ProgressTable.SCHEMA).json(path)
