"""What a finding rests on: dealt once by finding, the same with evidence and records sent to all tasks or shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from wardenlake.operators import catalogue


def naive(findings, evidence, links, provenance):
    out = set()
    for p, f, e, a in findings:
        out |= {(p, f, "PRIMARY", e), (p, f, "ASSET", a)}
    for p, f, e in links:
        out |= {(p, f, "REFERENCED", e)} | {(p, f, "ASSET", a) for q, x, a in evidence if q == p and x == e and p is not None and e is not None}
    out |= {(p, f, "PROVENANCE", r) for p, f, kind, a in set(out) if kind == "ASSET" and a is not None for q, x, r in provenance if q == p and x == a}
    return {x for x in out if x[3] is not None}


@pytest.mark.parametrize("sent", [True, False])
def test_findings_are_dealt_once(spark, monkeypatch, sent):
    rng = random.Random(5)
    some = lambda *of: rng.choice((*of, None)) if rng.random() < 0.2 else rng.choice(of)
    ids = lambda x, n: tuple(f"{x}{i}" for i in range(n))
    project, e, a, r = ("p1", "p2"), ids("x", 6), ids("x", 5), ids("r", 4)  # evidence and assets of the same names
    findings = [(rng.choice(project), f"f{i}", some(*e), some(*a)) for i in range(40)]
    links = [(some(*project), f"f{rng.randrange(45)}", some(*e)) for _ in range(90)]
    evidence = [(some(*project), some(*e), some(*a)) for _ in range(14)]
    provenance = [(some(*project), some(*a), some(*r)) for _ in range(16)]
    frames = [spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split())) for rows, columns in ((findings, "project_id finding_id evidence_id asset_id"), (evidence, "project_id evidence_id asset_id"), (links, "project_id finding_id evidence_id"), (provenance, "project_id asset_id record_id"))]
    if not sent:
        monkeypatch.setattr(catalogue, "counted", lambda df: df)
    df = catalogue.traceability(*frames)
    got = df.groupBy("project_id", "finding_id", "kind").agg(F.collect_list("ref").alias("refs"))
    if sent:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the rest and what sums it up keep the dealing
    rows = [(x["project_id"], x["finding_id"], x["kind"], ref) for x in got.collect() for ref in x["refs"]]
    assert len(rows) == len(set(rows)) and set(rows) == naive(findings, evidence, links, provenance)
