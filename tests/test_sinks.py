"""The catalogue's two phases, accounted intake and progress of streams."""

import time

import pytest
from pyspark.sql import functions as F

from wardenlake.functions.shared import fresh_path
from wardenlake.sources import catalog_sink
from wardenlake.streaming import streams

ROWS = "id long, text string"


def test_tables_are_written_together_and_once(spark):
    root = fresh_path(spark, "catalogue")
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (None, "z"), (4, None), (5, None)], ROWS)
    assert catalog_sink.read(spark, root, "a") is None
    assert catalog_sink.write(root, {"a": (a, "id"), "b": (a.where("id = 2"), "id")}) == {"a": 4, "b": 1}
    assert catalog_sink.write(root, {"a": (a, "id"), "b": (a.where("id = 2"), "id")}) == {"a": 0, "b": 0}
    more = spark.createDataFrame([(9, "new"), (8, "new"), (7, "x")], ROWS)
    assert catalog_sink.write(root, {"a": (more, "id"), "b": (more.limit(0), "id")}) == {"a": 1, "b": 0}
    got = {r["text"]: (r["id"], r["sequence"]) for r in catalog_sink.read(spark, root, "a").collect()}
    assert {t: i for t, (i, _) in got.items()} == {"x": 1, "y": 2, "z": None, None: 4, "new": 8} and sorted(s for _, s in got.values()) == [0, 1, 2, 3, 4] and got["new"][1] == 4
    assert catalog_sink.manifests(spark, root).select("number").distinct().count() == 2


def test_a_failed_write_leaves_nothing_to_see(spark):
    root = fresh_path(spark, "catalogue")
    a = spark.createDataFrame([(i, f"t{i}") for i in range(20)], ROWS)
    catalog_sink.write(root, {"a": (a.where("id < 5"), "id")})
    bad = a.withColumn("text", F.when(F.col("id") == 19, F.raise_error(F.lit("lost"))).otherwise(F.col("text")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        catalog_sink.write(root, {"b": (a, "id"), "a": (bad, "id")})
    assert catalog_sink.read(spark, root, "a").count() == 5 and catalog_sink.read(spark, root, "b") is None
    assert catalog_sink.vacuum(spark, root) == 1 and catalog_sink.vacuum(spark, root) == 0  # b's folder of the failed attempt
    assert catalog_sink.write(root, {"a": (a, "id"), "b": (a, "id")}) == {"a": 15, "b": 20}
    seq = [r["sequence"] for r in catalog_sink.read(spark, root, "a").collect()]
    assert sorted(seq) == list(range(20))


def test_writers_that_meet(spark, monkeypatch):
    """Another writer commits while this one has written its data: it looks again, and neither loses or doubles a row."""
    root = fresh_path(spark, "catalogue")
    a = spark.createDataFrame([(i, f"t{i}") for i in range(10)], ROWS)
    commit, met = catalog_sink._commit, []

    def slow(*args):
        if not met:
            met.append(1)
            catalog_sink.write(root, {"a": (a.where("id < 6"), "id")})
        return commit(*args)

    monkeypatch.setattr(catalog_sink, "_commit", slow)
    assert catalog_sink.write(root, {"a": (a, "id")}) == {"a": 4}
    got = catalog_sink.read(spark, root, "a").collect()
    assert sorted(r["id"] for r in got) == list(range(10)) and sorted(r["sequence"] for r in got) == list(range(10))
    monkeypatch.setattr(catalog_sink, "_commit", lambda *args: False)
    with pytest.raises(catalog_sink.Conflict):
        catalog_sink.write(root, {"a": (spark.createDataFrame([(1, "other")], ROWS), "id")}, tries=2)


def test_intake_adds_up(spark):
    folder = fresh_path(spark, "in")
    one = spark.createDataFrame([(1, "2024-01-10 00:00:00"), (2, None), (3, ""), (4, "soon"), (5, "2024-01-01 00:00:00")], "id long, t string")
    two = spark.createDataFrame([(6, "2024-01-08 00:00:00"), (7, "2024-01-09 00:00:00"), (8, "2024-02-01 00:00:00"), (9, "2024-01-09 12:00:00")], "id long, t string")
    for df in (one, two):
        df.coalesce(1).write.mode("append").parquet(folder)
    accepted, dead, counts = streams.run_accounted(streams.read_stream(spark, folder, 1), "t", F.try_to_timestamp("t", F.lit("yyyy-MM-dd HH:mm:ss")), 86_400)
    assert {r["id"] for r in accepted.collect()} == {1, 5, 7, 8, 9}  # nothing is late in the first batch; the border is not late
    assert {r["id"]: r["reason"] for r in dead.collect()} == {2: "MISSING_TIME", 3: "MISSING_TIME", 4: "INVALID_TIME", 6: "TOO_LATE"}
    assert counts.agg(F.sum("n")).first()[0] == 9
    # a batch that is repeated overwrites itself
    batch = spark.read.parquet(folder)
    own = fresh_path(spark, "own")
    run = streams.accounting(own, "t", F.try_to_timestamp("t", F.lit("yyyy-MM-dd HH:mm:ss")), 86_400)
    for number in (0, 1, 1):
        run(batch, number)
    assert spark.read.parquet(f"{own}/rows").count() == 18 and streams._counts(spark, own).agg(F.sum("n")).first()[0] == 18


def test_sequences_without_numbers_go_on(spark):
    folder = fresh_path(spark, "in")
    spark.createDataFrame([(1, 1, "a"), (1, None, "b"), (1, 2, None), (1, 2, "a"), (1, 5, "c")], "k long, s long, x string").coalesce(1).write.parquet(folder)
    [r] = streams.run_available(streams.sequence_check(streams.read_stream(spark, folder), "k", "s", "x"), "update", ["k"]).collect()
    assert (r["n"], r["n_gaps"], r["n_back"], r["n_replayed"], r["n_unknown"]) == (5, 1, 0, 1, 2)


def test_progress_becomes_rows(spark):
    folder, path = fresh_path(spark, "in"), fresh_path(spark, "progress")
    for i in range(2):
        spark.range(10 * (i + 1)).coalesce(1).write.mode("append").parquet(folder)
    listener = catalog_sink.ProgressTable(spark, path)
    spark.streams.addListener(listener)
    try:
        streams.run_available(streams.read_stream(spark, folder, 1), "append")
        for _ in range(60):
            time.sleep(0.5)
            try:
                rows = catalog_sink.progress(spark, path).collect()
            except Exception:  # nothing is written yet
                continue
            if any(r["event"] == "ENDED" for r in rows):
                break
    finally:
        spark.streams.removeListener(listener)
    assert {r["event"] for r in rows} == {"STARTED", "PROGRESS", "ENDED"}
    assert sorted(r["rows_in"] for r in rows if r["event"] == "PROGRESS" and r["rows_in"]) == [10, 20]
