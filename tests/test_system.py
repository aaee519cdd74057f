"""System queries: one pass where there was one for each case."""

import numpy as np
from pyspark.sql import functions as F

from wardenlake.operators import drift, images, mutations
from wardenlake.plans import system_queries

FOLDER = "/root/testdata/sf0.001"


def leaves(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def test_a_picture_is_drawn_once_for_all_perturbations(spark):
    df = system_queries.perturbation_sensitivity(spark, FOLDER)
    assert leaves(df) == 1
    k = spark.read.parquet(f"{FOLDER}/part.parquet").toPandas()["p_partkey"]
    y, x, c = np.mgrid[:32, :32, :3]
    drawn = [((x * (i % 7 + 1) + y * (i % 5 + 1) + 40 * c + i) % 256).astype(np.uint8) for i in k]
    for r in df.collect():
        hurt = [images.perturb(a, r["perturbation"], 7) for a in drawn]
        rmse = np.mean([np.sqrt(np.mean((a.astype(float) - b) ** 2)) for a, b in zip(drawn, hurt, strict=True)])
        moved = np.mean([np.linalg.norm(np.subtract(images.visual_vector(a), images.visual_vector(b))) for a, b in zip(drawn, hurt, strict=True)])
        assert abs(r["input_rmse"] - rmse) < 6e-5 and abs(r["output_l2"] - moved) < 6e-7 and r["status"] == ("MEASURED" if moved > 1e-12 else "INSENSITIVE")


def test_histograms_are_numpys():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(-20, 280, 3000), np.arange(-1, 258), [255.9999999999, 256.0, 256.0000001]])
    for bins in (16, 32):
        assert np.array_equal(images._histogram(x, bins), np.histogram(x, bins, (0, 256))[0])


def test_the_cases_of_the_mutation_suite_are_groups(spark):
    """One plan for all damages, not one for each; the outcomes are those of each damage by itself."""
    df = system_queries.mutation_suite(spark, FOLDER)
    assert leaves(df) < 60
    want = {}
    o = spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey", "o_totalprice", F.abs(F.hash("o_orderpriority") % 5).alias("label"))
    for name, hurt in {"shift_feature": mutations.shift_feature(o, "o_totalprice", 60000.0), "scale_feature": mutations.scale_feature(o, "o_totalprice", 1.6), "drop_none": o, "flip_labels": mutations.flip_labels(o, "o_orderkey", "label", 5, 0.4), "target_label": mutations.target_label(o, "o_orderkey", "label", 1, 2, 0.9)}.items():
        pair = o.withColumn("is_target", F.lit(False)).union(hurt.withColumn("is_target", F.lit(True)))
        seen = drift.psi(drift.melt(pair, F.col("is_target"), ["o_totalprice"])).first()["psi"] >= 0.10 or drift.categorical(pair).first()["tvd"] >= 0.05
        want[name] = "DETECTED" if seen else "MISSED"
    assert {r["mutation"]: r["outcome"] for r in df.collect()} == want and want["drop_none"] == "MISSED" and set(want.values()) == {"DETECTED", "MISSED"}
