"""Relational lookups over the catalogue: findings, evidence, samples, versions, provenance. Every join carries project_id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import materialize


def evidence_of_findings(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """finding_id's evidence within its project."""
    return evidence.join(findings, ["project_id", "finding_id"])


def samples_of_datasets(samples: DataFrame, versions: DataFrame, datasets: DataFrame) -> DataFrame:
    """samples with their version's and dataset's columns, within their project."""
    return samples.join(versions, ["project_id", "version_id"]).join(datasets, ["project_id", "dataset_id"])


def of_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids: a semi-join, however many there are."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def counted(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df written, and sent to all tasks of a join if it has few rows."""
    out = materialize(df, "known")
    return F.broadcast(out) if out.count() <= most else out


def traceability(findings: DataFrame, evidence: DataFrame, links: DataFrame, provenance: DataFrame) -> DataFrame:
    """A row for each thing a finding rests on: project_id, finding_id, kind (PRIMARY, REFERENCED, ASSET, PROVENANCE), ref. Equal ids of two projects are different things.

    findings: project_id, finding_id, evidence_id, asset_id; links: project_id, finding_id, evidence_id; evidence: project_id, evidence_id, asset_id; provenance: project_id, asset_id, record_id."""
    of = ["project_id", "finding_id"]
    primary = findings.select(*of, F.lit("PRIMARY").alias("kind"), F.col("evidence_id").alias("ref"), "asset_id")
    referenced = links.select(*of, F.lit("REFERENCED"), "evidence_id", F.lit(None))
    # dealt once by finding; from here on each step keeps that dealing, so that what a finding rests on is never shuffled
    dealt = primary.union(referenced).repartition(*of)
    assets = evidence.where("asset_id is not null").select(F.col("project_id").alias("__project"), F.col("evidence_id").cast(dealt.schema["ref"].dataType).alias("__id"), F.col("asset_id").alias("__asset"))
    met = dealt.join(counted(assets), (F.col("kind") == "REFERENCED") & (F.col("project_id") == F.col("__project")) & (F.col("ref") == F.col("__id")), "left")
    own = F.array(F.struct("kind", "ref"), F.struct(F.lit("ASSET").alias("kind"), F.coalesce("asset_id", "__asset").alias("ref")))
    first = met.select(*of, F.explode(own).alias("x")).select(*of, "x.kind", "x.ref").where("ref is not null").distinct()
    # an asset becomes itself (no record) and each of its records
    records = provenance.where("asset_id is not null").select(F.col("project_id").alias("__project"), F.col("asset_id").cast(first.schema["ref"].dataType).alias("__id"), F.col("record_id").alias("__record")).distinct()
    records = records.where("__record is not null").union(records.select("__project", "__id", F.lit(None)).distinct())
    every = first.join(counted(records), (F.col("kind") == "ASSET") & (F.col("project_id") == F.col("__project")) & (F.col("ref") == F.col("__id")), "left")
    return every.select(*of, F.when(F.col("__record").isNotNull(), "PROVENANCE").otherwise(F.col("kind")).alias("kind"), F.coalesce("__record", "ref").alias("ref")).distinct()


def neighbours(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str], outgoing: bool = True) -> DataFrame:
    """project_id, node, other, kind, other_type over edges of the given kinds: the many-to-many lookups between findings and evidence, within a project."""
    a, b = ("src", "dst") if outgoing else ("dst", "src")
    e = edges.where(F.col("kind").isin(list(kinds))).select("project_id", F.col(a).alias("node"), F.col(b).alias("other"), "kind")
    return e.join(nodes.select("project_id", F.col("node").alias("other"), F.col("type").alias("other_type")), ["project_id", "other"]).select("project_id", "node", "other", "kind", "other_type")


def by_key(df: DataFrame, keys: dict[str, object]) -> DataFrame:
    """The rows with these values of a primary or an alternate key; null finds null. The comparison reaches the scan's filters."""
    for name, value in keys.items():
        df = df.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return df


def proof_status(evidence: DataFrame, provenance: DataFrame) -> DataFrame:
    """project_id, asset_id, status, fatal: proof evidence needs a provenance record that holds; without one it is MISSING, which is fatal.

    provenance: project_id, asset_id, valid."""
    proof = evidence.where("layer = 'PROOF'").groupBy("project_id", "asset_id").agg(F.count("*").alias("n"), F.max(F.lower("severity").isin("critical", "high")).alias("grave"))
    known = provenance.groupBy("project_id", "asset_id").agg(F.min(F.col("valid").cast("int")).alias("ok"))
    j = proof.join(known, ["project_id", "asset_id"], "left")
    status = F.when(F.col("ok").isNull(), "MISSING").when(F.col("ok") == 0, "INVALID").otherwise("VERIFIED")
    return j.select("project_id", "asset_id", "n", status.alias("status"), (F.col("ok").isNull() | (F.col("ok") == 0)).alias("fatal"))


def summary(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Counts and the value's total by every grouping of the keys (a cube), with the grouping's number."""
    return df.cube(*keys).agg(F.grouping_id().cast("long").alias("grouping"), F.count("*").alias("n"), F.sum(value).alias("total"))


def fingerprints(samples: DataFrame, raw: Column, parts: Sequence[Column]) -> DataFrame:
    """samples with fingerprint: sha256 over the raw digest and the sorted digests of the parts."""
    digests = F.array_join(F.array_sort(F.array(*(F.sha2(p, 256) for p in parts))), "|")
    return samples.withColumn("fingerprint", F.sha2(F.concat_ws("|", F.sha2(raw, 256), digests), 256))
