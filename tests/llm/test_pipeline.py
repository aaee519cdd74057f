"""The stages keep clean documents, their decisions take effect, and each works on what the one before kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardenlake.llm.common import materialize

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    out["in"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialize(stage(spark, docs, FOLDER), name)
    return out


def test_columns_and_sizes(stages):
    columns = stages["in"].columns
    assert all(stages[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    n = {k: v.count() for k, v in stages.items()}
    assert n["language_id"] >= 0.99 * n["in"] and 0.85 * n["in"] < n["near_duplicates"] < n["language_id"] and n["secret_scan"] == n["near_duplicates"]


def test_near_duplicates_leave_one_of_each_group(spark, stages):
    kept = {r["doc_id"]: r["text"] for r in stages["near_duplicates"].collect()}
    sets = {}
    for i, t in kept.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    seen = {}
    for i, s in sets.items():
        for g in s:
            seen.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in seen.values() for a in ids for b in ids if a < b}
    assert not [p for p in pairs if 100 * len(sets[p[0]] & sets[p[1]]) >= 80 * len(sets[p[0]] | sets[p[1]])]


def test_secrets_are_gone(stages):
    hits = stages["secret_scan"].where(F.col("text").rlike("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")).count()
    assert hits == 0 and stages["near_duplicates"].where(F.col("text").rlike("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")).count() > 0


def test_mix_and_packing(stages):
    by = stages["mixing"].groupBy("doc_id").count()
    assert by.agg(F.max("count")).first()[0] <= 3
    packed = stages["packing"]
    assert packed.where("piece = 0").count() == stages["mixing"].count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_edges(spark):
    clash = ("rows", "same", "unit_key", "often", "i", "start", "kept_id", "n", "size", "declared", "host", "spans", "b", "piece", "sequence_id")
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, kept boolean"
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, None, None, None, "n", True), (None, "some plain words here", "en", None, 1, "n", True), (2, "some plain words here", "en", "s", 1, None, None), (2, "some plain words here", "en", "s", 1, None, None)], schema)
    for docs in (empty, odd):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, FOLDER), "edge")
        docs.count()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.select("*", *(F.lit(c).alias(c) for c in clash))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, FOLDER), "edge")
        assert out.columns == docs.columns and {tuple(r) for r in out.select(*clash).distinct().collect()} == {clash}
        docs = out
