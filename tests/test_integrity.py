"""Chains with missing and repeated pieces, over one and over many ranges; lookups that stay within a project; rounding."""

import random

import pytest
from pyspark.sql import functions as F

from wardenlake.functions.stats import round6
from wardenlake.operators import catalogue, integrity

RECORD = "k long, i long, payload string, nonce string"


def chain(spark, n=40):
    return integrity.build_chain(spark.createDataFrame([(k, i, f"p{i}" if i % 9 else None, f"n{k}-{i}") for k in (1, 2) for i in range(n)], RECORD), ["k"], "i", F.col("payload"))


def codes(df, **options):
    rows = integrity.verify_chain(df, ["k"], F.col("payload"), **options).collect()
    return {(r["k"], r["i"]): r["codes"] for r in rows if r["codes"]}


@pytest.mark.parametrize("ranges", [1, 7])
def test_missing_pieces_are_failures(spark, ranges):
    c = chain(spark).where("k = 1")
    assert codes(c, ranges=ranges) == {}
    at = lambda i: F.col("i") == i
    lost = c.withColumns({"record_hash": F.when(~at(39), F.col("record_hash")), "previous_hash": F.when(~at(39), F.col("previous_hash"))})
    assert codes(lost, ranges=ranges) == {(1, 39): ["MISSING_HASH", "BROKEN_CHAIN"]}
    middle = c.withColumn("record_hash", F.when(~at(5), F.col("record_hash")))
    assert codes(middle, ranges=ranges) == {(1, 5): ["MISSING_HASH"], (1, 6): ["BROKEN_CHAIN"]}
    none = c.withColumn("nonce", F.when(~F.col("i").isin(3, 4), F.col("nonce")))
    assert codes(none, ranges=ranges) == {(1, 3): ["MISSING_NONCE"], (1, 4): ["MISSING_NONCE"]}
    unplaced = c.withColumn("sequence_number", F.when(~at(39), F.col("sequence_number")))
    assert codes(unplaced, ranges=ranges) == {(1, 39): ["MISSING_SEQUENCE"]}
    emptied = c.withColumn("payload", F.when(~at(7), F.col("payload")))
    assert codes(emptied, ranges=ranges) == {(1, 7): ["CONTENT_ALTERED"]}
    assert codes(c.limit(0), ranges=ranges) == {}


def test_ranges_change_nothing(spark):
    """Altered, lost, doubled and moved records of several chains, one with a null key: one window a chain and 16 ranges give the same codes."""
    rng = random.Random(4)
    rows = []
    for r in chain(spark, 150).collect():
        r = r.asDict()
        r["k"] = None if r["k"] == 2 else 1
        if rng.random() < 0.06:
            continue
        for field in ("nonce", "record_hash", "previous_hash", "payload"):
            if rng.random() < 0.05:
                r[field] = rng.choice((None, "same"))
        if rng.random() < 0.05:
            r["sequence_number"] = rng.choice((None, r["sequence_number"] + 1, 3))
        rows += [r] * (2 if rng.random() < 0.05 else 1)
    df = spark.createDataFrame(rows, chain(spark, 1).schema).withColumn("ts", F.timestamp_seconds(F.col("i") - 3 * (F.col("i") % 11)))
    got = [sorted(map(repr, integrity.verify_chain(df, ["k"], F.col("payload"), time="ts", ranges=n).collect())) for n in (1, 16)]
    assert got[0] == got[1] and any("MISSING_HASH" in r for r in got[0]) and any("clock_step_back=True" in r for r in got[0])


def test_projects_do_not_mix(spark):
    """Two projects with the same evidence: each finding gets its own project's asset and record."""
    f = spark.createDataFrame([("p1", "f1", "e1", None), ("p2", "f1", "e1", None)], "project_id string, finding_id string, evidence_id string, asset_id string")
    e = spark.createDataFrame([("p1", "e1", "a1"), ("p2", "e1", "a9")], "project_id string, evidence_id string, asset_id string")
    p = spark.createDataFrame([("p1", "a1", "r1"), ("p2", "a9", "r9"), ("p2", "a1", "r8")], "project_id string, asset_id string, record_id string")
    got = sorted(tuple(r) for r in catalogue.traceability(f, e, f.select("project_id", "finding_id", "evidence_id"), p).collect())
    own = lambda project, a, r: [(project, "f1", "ASSET", a), (project, "f1", "PRIMARY", "e1"), (project, "f1", "PROVENANCE", r), (project, "f1", "REFERENCED", "e1")]
    assert got == own("p1", "a1", "r1") + own("p2", "a9", "r9")
    nodes = spark.createDataFrame([("p1", "e1", "EVIDENCE"), ("p2", "e1", "LOG"), ("p1", "f1", "FINDING")], "project_id string, node string, type string")
    edges = spark.createDataFrame([("p1", "f1", "e1", "SUPPORTS"), ("p2", "f1", "e1", "SUPPORTS"), ("p1", "f1", "e1", "OTHER")], "project_id string, src string, dst string, kind string")
    assert sorted(tuple(r) for r in catalogue.neighbours(nodes, edges, ["SUPPORTS"]).collect()) == [("p1", "f1", "e1", "SUPPORTS", "EVIDENCE"), ("p2", "f1", "e1", "SUPPORTS", "LOG")]
    assert [tuple(r) for r in catalogue.neighbours(nodes, edges, ["SUPPORTS"], outgoing=False).collect()] == [("p1", "e1", "f1", "SUPPORTS", "FINDING")]
    assert catalogue.by_key(f, {"project_id": "p2", "asset_id": None}).count() == 1 and catalogue.by_key(f, {"asset_id": "a"}).count() == 0


def test_rounding_does_not_hang_on_last_bits(spark):
    x = 0.1234565
    rows = [(x,), (x + 2e-16,), (x - 2e-16,), (sum([0.02] * 5 + [0.0234565]),), (None,), (0.1234564999,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(round6(F.col("x"))).collect()]
    assert got == [0.123457, 0.123457, 0.123457, 0.123457, None, 0.123456]
