"""Profiles of classes: imbalance, impact, keys without a population."""

import math

from pyspark.sql import functions as F

from wardenlake.operators import drift


def rows_of(spark, counts):
    rows = [(k, t, label) for k, label, r, n in counts for t, m in ((False, r), (True, n)) for _ in range(m)]
    return spark.createDataFrame(rows, "k string, is_target boolean, label string")


def test_label_profile(spark):
    counts = [
        ("even", "a", 50, 50), ("even", "b", 50, 50), ("rare", "a", 100, 100), ("rare", "b", 10, 10), ("one", "a", 20, 20), ("new", "a", 50, 40), ("new", "x", 0, 1), ("many", "a", 50, 40),
        ("many", "x", 0, 1), ("many", "y", 0, 1), ("many", "z", 0, 1), ("moved", "a", 90, 50), ("moved", "b", 10, 50), ("old", "a", 5, 0), ("fresh", "a", 0, 3), ("fresh", "b", 0, 30), ("null", None, 5, 5), ("null", "a", 5, 5),
    ]
    df = rows_of(spark, counts).union(spark.createDataFrame([("even", None, "q"), (None, True, "a")], "k string, is_target boolean, label string"))
    got = {r["k"]: r for r in drift.label_profile(df, keys=["k"]).collect()}
    assert {k: (r["n_classes"], r["imbalance_ratio"], r["imbalanced"], r["impact"]) for k, r in got.items()} == {
        "even": (2, 1.0, False, "NEGLIGIBLE"), "rare": (2, 10.0, True, "NEGLIGIBLE"), "one": (1, None, False, "NEGLIGIBLE"), "new": (2, 40.0, True, "HIGH"), "many": (4, 40.0, True, "CRITICAL"),
        "moved": (2, 1.0, False, "HIGH"), "old": (0, None, False, "NEGLIGIBLE"), "fresh": (2, 10.0, True, "NEGLIGIBLE"), "null": (2, 1.0, False, "NEGLIGIBLE"), None: (1, None, False, "NEGLIGIBLE"),
    }
    assert got["moved"]["status"] == "MATERIAL_SHIFT" and math.isclose(got["moved"]["tvd"], 0.4)
    assert {k for k, r in got.items() if r["status"] == "INSUFFICIENT_DATA" and r["tvd"] is None} == {"old", "fresh", None}
    whole = drift.label_profile(df.where("k = 'rare'")).collect()
    assert len(whole) == 1 and (whole[0]["imbalance_ratio"], whole[0]["status"]) == (10.0, "NO_SHIFT_DETECTED")
    assert drift.label_profile(df.limit(0)).count() == drift.label_profile(df.limit(0), keys=["k"]).count() == 0
    assert drift.label_profile(df.where("k = 'old'")).first()["status"] == "INSUFFICIENT_DATA"


def test_impacts(spark):
    rows = [("MATERIAL_SHIFT", 0.25, "HIGH"), ("MATERIAL_SHIFT", 0.2, "MEDIUM"), ("SIGNIFICANT_SHIFT", 0.9, "LOW"), ("SHIFT_DETECTED", 0.9, "MEDIUM"), ("NO_SHIFT_DETECTED", 0.9, "NEGLIGIBLE"), (None, 0.1, "NEGLIGIBLE")]
    df = spark.createDataFrame(rows, "s string, e double, want string")
    assert df.where(drift.feature_impact(F.col("s"), F.col("e")) != F.col("want")).count() == 0
