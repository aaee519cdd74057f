"""Hamming index and duplicate groups, lineage by levels, digests that stream, tables of a run."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardenlake.functions import shared
from wardenlake.operators import duplicates, integrity, risk


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def distance(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize("radius", [0, 3, 10, 17])
def test_every_plan_finds_all_pairs(spark, radius):
    """Few and many tables alike; each pair once."""
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(12)]
    h = sorted({signed(b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(radius + 3)))) for b in base for _ in range(12)})
    want = {(a, b) for i, a in enumerate(h) for b in h[i + 1 :] if distance(a, b) <= radius}
    df = spark.createDataFrame([(x,) for x in h], "h long")
    for tables in (4, 16):
        got = [tuple(r) for r in duplicates.near_classes(df, radius, duplicates._plan(radius, tables)).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in duplicates.near_classes(df, radius).collect()} == want


def test_few_candidates(spark):
    """Of random hashes less than a hundredth of all pairs meet at radius 10; bands of 5 bits let a fifth meet."""
    rng = np.random.default_rng(1)
    n = 4000
    df = spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63 - 1, n)], "h long")
    met = duplicates.near_classes(df, 10, duplicates._plan(10, 4), candidates=True).count()
    assert 0 < met < 0.01 * n * (n - 1) / 2
    assert [w for _, w, _ in duplicates.index_plan(10, 10**9)] < [w for _, w, _ in duplicates.index_plan(10, 10**3)] or len(duplicates.index_plan(10, 10**9)) < len(duplicates.index_plan(10, 10**3))


def test_weighted_looks_in_both_hashes(spark):
    rng = random.Random(8)
    p, d = rng.getrandbits(64), rng.getrandbits(64)
    rows = [(0, p, d)] + [(i, p ^ sum(1 << k for k in rng.sample(range(64), a)), d ^ sum(1 << k for k in rng.sample(range(64), b))) for i, (a, b) in enumerate([(17, 0), (16, 1), (0, 25), (1, 24), (10, 10), (11, 11), (18, 0), (0, 26)], 1)]
    df = spark.createDataFrame([(i, signed(a), signed(b)) for i, a, b in rows], "sample_id long, phash long, dhash long")
    want = {(i, j) for i, a, b in rows for j, e, f in rows if i < j and round(0.6 * (1 - distance(a, e) / 64) + 0.4 * (1 - distance(b, f) / 64), 4) >= 0.84}
    assert {(r["a"], r["b"]) for r in duplicates.relationships(df, strategy="weighted").collect()} == want and want


def test_groups_without_pairs(spark):
    """100,000 equal hashes would make five billion pairs; groups are those that all pairs give on a small table."""
    many = spark.range(100_000).select(F.col("id").alias("sample_id"), F.lit(5).cast("long").alias("phash"), F.col("id").alias("dhash"))
    odd = spark.createDataFrame([(200_000, 7, -1), (200_001, -(2**63), 2**62), (200_002, None, 2**62 + 1)], "sample_id long, phash long, dhash long")
    [[n, root]] = duplicates.duplicate_groups(many.union(odd), strategy="any", d_radius=0).where("node < 200001").agg(F.count("*"), F.max("root")).collect()
    assert (n, root) == (100_001, 0)
    rng = random.Random(3)
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(8)]
    flip = lambda x: signed(x ^ sum(1 << k for k in rng.sample(range(64), rng.choice((0, 0, 2, 9, 12)))))
    df = spark.createDataFrame([(i, flip(base[i % 8][0]), flip(base[(i // 3) % 8][1])) for i in range(90)], "sample_id long, phash long, dhash long")
    for strategy in ("any", "both", "weighted"):
        pairs = {tuple(sorted(map(tuple, duplicates.clusters(duplicates.relationships(df, strategy=strategy)).collect())))}
        assert pairs == {tuple(sorted(map(tuple, duplicates.duplicate_groups(df, strategy=strategy).collect())))}


def test_digests_stream(spark):
    rows = [(k, f"m{i}") for k in ("a", None, "b") for i in range(700)] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, m string")
    got = {r["k"]: (r["n"], r["digest"]) for r in integrity.joined_digests(df, ["k"], "m", ",").collect()}
    digest = hashlib.sha256(",".join(sorted(f"m{i}" for i in range(700))).encode()).hexdigest()
    assert got == {k: (700, digest) for k in ("a", None, "b")}
    assert integrity.joined_digests(df.limit(0), ["k"], "m").count() == 0


def effective(nodes, edges):
    """Straight recursion."""
    parents = {}
    for s, d, w in edges:
        parents.setdefault(d, []).append((s, w))
    found = {}

    def at(n):
        if n not in found:
            keep = 1 - nodes[n]
            for s, w in parents.get(n, []):
                keep *= 1 - min(1, max(0, risk.GAMMA * w * at(s)))
            found[n] = round(min(1, max(0, 1 - keep)), 6) if parents.get(n) else round(nodes[n], 6)
        return found[n]

    return {n: at(n) for n in nodes}


def test_lineage_of_a_deep_chain(spark):
    """A level a node, with shortcuts over many: late parents count."""
    n = 24
    nodes = {f"n{i}": (i * 7 % 10) / 10 for i in range(n)}
    edges = [(f"n{i}", f"n{i + 1}", 0.5) for i in range(n - 1)] + [("n0", f"n{i}", 0.25) for i in range(10, n, 10)] + [("n3", f"n{n - 1}", 1.0), ("n0", "n1", 0.5)]
    a = spark.createDataFrame(list(nodes.items()), "node string, risk double")
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    got = risk.propagate(a, e).collect()
    assert len(got) == n
    want = effective(nodes, edges)
    assert all(abs(r["effective"] - want[r["node"]]) < 2e-6 for r in got)
    by = {r["node"]: r["level"] for r in risk.levels(a, e).collect()}
    assert by == {f"n{i}": i for i in range(n)}


def test_levels_of_cycles_and_strays(spark):
    a = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3), ("d", 0.4), ("e", 0.5), (None, 0.6), ("a", 0.1)], "node string, risk double")
    e = spark.createDataFrame([("b", "c", 1.0), ("c", "b", 1.0), ("c", "d", 1.0), ("ghost", "e", 1.0), (None, "a", 1.0), ("a", None, 1.0)], "src string, dst string, weight double")
    assert {r["node"]: r["level"] for r in risk.levels(a, e).collect()} == {"a": 0, "b": None, "c": None, "d": None, "e": 0, None: 0}
    with pytest.raises(ValueError, match="cycle"):
        risk.propagate(a, e)
    assert risk.levels(a.limit(0), e.limit(0)).count() == 0


def test_tables_of_a_run_are_counted(spark):
    before = set(shared.kept(spark))
    df = shared.materialize(spark.range(5), "mine")
    new = set(shared.kept(spark)) - before
    assert len(new) == 1 and next(iter(new)).startswith("mine-") and df.count() == 5
    shared.discard(df)
    assert set(shared.kept(spark)) == before
