"""Matching of detections by joins against a greedy pass over all pairs."""

import collections
import random

import pytest

from wardenlake.operators import inference

SCHEMA = "image string, box array<double>, label int, score double"


def iou(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda v: (v[2] - v[0]) * (v[3] - v[1])
    union = area(a) + area(b) - w * h
    return w * h / union if union else 0.0


def greedy(ref, got, at):
    out = {}
    for image in {x[0] for x in ref + got}:
        r, c = [x for x in ref if x[0] == image], [x for x in got if x[0] == image]
        low = lambda s: float("inf") if s is None else -s
        pairs = sorted((-iou(a[1], b[1]), a[2] != b[2], low(b[3]), low(a[3]), a[1], b[1], a[2], b[2], i, k) for i, a in enumerate(r) for k, b in enumerate(c) if a[1][2] > a[1][0] and a[1][3] > a[1][1] and iou(a[1], b[1]) >= at)
        seen, taken = (set(), set()), []
        for p in pairs:
            if p[8] not in seen[0] and p[9] not in seen[1]:
                seen[0].add(p[8]), seen[1].add(p[9]), taken.append(p)
        n = len(taken)
        out[image] = (len(r), len(c), n, round(-sum(p[0] for p in taken) / n, 9) if n else 0.0, sum(not p[1] for p in taken) / n if n else None)
    return out


def boxes(rng, n, images, grid):
    out = []
    for _ in range(n):
        x, y, w, h = rng.randrange(grid), rng.randrange(grid), rng.choice((1, 2, 3, 7, 8, 30)) * rng.choice((1.0, 1.3)), rng.choice((1, 2, 8, 31))
        out.append((rng.choice(images), [x - 20.0, y - 20.0, x + w - 20.0, y + h - 20.0], rng.randrange(3), rng.choice((None, 0.5, rng.random()))))
    return out + rng.choices(out, k=n // 5)


@pytest.mark.parametrize("at", [0.1, 0.3, 0.5, 0.8, 1.0])
def test_equals_the_greedy_pass(spark, at):
    rng = random.Random(at)
    ref, got = boxes(rng, 150, ["a", "b", "hot", "hot"], 40), boxes(rng, 150, ["a", "c", "hot", "hot"], 40)
    ref += [("d", [1.0, 1.0, 1.0, 4.0], 1, 0.5), ("d", [3.0, 3.0, 1.0, 1.0], 1, 0.5)]
    got += [("d", [1.0, 1.0, 1.0, 4.0], 1, 0.5), ("d", [3.0, 3.0, 1.0, 1.0], 1, 0.5)]
    rows = inference.match_detections(spark.createDataFrame(ref, SCHEMA), spark.createDataFrame(got, SCHEMA), "image", at).collect()
    assert {r["image"]: (r["n_reference"], r["n_candidate"], r["n_matched"], round(r["mean_iou"], 9), r["class_agreement"]) for r in rows} == greedy(ref, got, at)


def test_pairs_meet_once(spark):
    """The grid finds every pair that overlaps enough, and each once."""
    rng = random.Random(8)
    ref, got = boxes(rng, 300, ["i"], 60), boxes(rng, 300, ["i"], 60)
    frame = lambda rows: spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], f"id long, {SCHEMA}")
    for at in (0.05, 0.5, 0.9):
        found = collections.Counter((r["r"], r["c"]) for r in inference.overlapping(frame(ref), frame(got), "image", at).collect())
        assert found == {(i, k): 1 for i, a in enumerate(ref) for k, b in enumerate(got) if iou(a[1], b[1]) >= at}


def test_copies_make_no_pairs(spark):
    """Sixty thousand copies of a box on either side, and a crowd that overlaps nowhere: one pair of classes."""
    one = spark.range(60_000).selectExpr("'x' image", "array(0D, 0D, 4D, 4D) box", "1 label", "0.5D score")
    crowd = spark.range(60_000).selectExpr("'x' image", "array(id * 9D + 9, 0D, id * 9D + 13, 4D) box", "1 label", "0.5D score")
    r = inference.match_detections(one.union(crowd), one.limit(50_000).union(crowd.limit(100)), "image").first()
    assert (r["n_reference"], r["n_candidate"], r["n_matched"], r["mean_iou"], r["class_agreement"]) == (120_000, 50_100, 50_100, 1.0, 1.0)


def test_nulls_and_empty_tables(spark):
    rows = [(None, [0.0, 0.0, 2.0, 2.0], None, None), ("i", None, 1, 0.5), ("i", [0.0, 0.0, float("nan"), 1.0], 1, 0.5), ("i", [0.0, 0.0, 1.0], 1, 0.5), ("i", [0.0, 0.0, float("inf"), 1.0], 1, 0.5)]
    df, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    got = {r["image"]: tuple(r)[1:] for r in inference.match_detections(df.withColumn("order", df.label).withColumn("r", df.label), df, "image").collect()}
    assert got == {None: (1, 1, 1, 1.0, 1.0), "i": (4, 4, 0, 0.0, None)}
    assert inference.match_detections(none, none, "image").count() == 0
    assert inference.match_detections(df, none, "image").where("n_matched > 0").count() == 0
    with pytest.raises(ValueError, match="above 0"):
        inference.match_detections(df, df, "image", 0.0)


@pytest.mark.parametrize("at", [0.1, 0.5])
def test_only_crowds_meet_on_the_grid(spark, monkeypatch, at):
    """Images with few boxes are matched in one pass by image: of all boxes only those of the crowded image are placed on the grid, and either way gives the greedy pass."""
    rng, placed, real = random.Random(3), [], inference.overlapping
    few = [f"i{i}" for i in range(40)]
    ref, got = boxes(rng, 200, few, 12) + boxes(rng, 90, ["hot"], 30), boxes(rng, 200, [*few, "other"], 12) + boxes(rng, 90, ["hot"], 30)
    monkeypatch.setattr(inference, "overlapping", lambda r, c, *rest: placed.append({x[0] for x in r.select("__image.image").distinct().collect()}) or real(r, c, *rest))
    r, c = spark.createDataFrame(ref, SCHEMA).repartition(7), spark.createDataFrame(got, SCHEMA).repartition(5)
    run = lambda **more: {x["image"]: (x["n_reference"], x["n_candidate"], x["n_matched"], round(x["mean_iou"], 9), x["class_agreement"]) for x in inference.match_detections(r, c, "image", at, **more).collect()}
    want = greedy(ref, got, at)
    assert run(crowd=100) == want and placed == [{"hot"}]
    assert run() == want and len(placed) == 1
    assert run(crowd=0) == want and len(placed) == 2
