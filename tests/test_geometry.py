"""Boxes in their forms."""

import pytest
from pyspark.sql import functions as F

from wardenlake.operators import inference


def test_forms_and_displacement(spark):
    rows = [(1, [2.0, 4.0, 6.0, 10.0]), (2, [0.0, 0.0, 0.0, 0.0]), (3, [1.0, 2.0, 3.0]), (4, None), (5, [1.0, None, 2.0, 3.0]), (6, [float("nan"), 0.0, 1.0, 1.0])]
    df, b = spark.createDataFrame(rows, "k int, box array<double>"), F.col("box")
    forms = {f: inference.box_form(b, "xyxy", f) for f in inference.BOX_FORMS}
    back = {f"{f}_back": inference.box_form(forms[f], f, "xyxy") for f in forms}
    shares = inference.box_form(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.2), F.lit(0.4)), "cxcywh", "xyxy", F.lit(100), F.lit(50))
    got = {r["k"]: r for r in df.select("k", *(c.alias(n) for n, c in (forms | back).items()), shares.alias("shares"), inference.box_area(b).alias("area"), inference.displacement(b, F.array(*map(F.lit, (5.0, 8.0, 9.0, 14.0)))).alias("far")).collect()}
    assert got[1]["xywh"] == [2, 4, 4, 6] and got[1]["cxcywh"] == [4, 7, 4, 6] and got[1]["area"] == 24 and got[1]["far"] == 5
    assert got[1]["shares"] == pytest.approx([40, 15, 60, 35])
    for k, box in rows[:2]:
        assert all(got[k][f"{f}_back"] == box for f in forms)
    assert all(got[k][f] is None for k in (3, 4, 5, 6) for f in forms)
    with pytest.raises(ValueError):
        inference.box_form(b, "xyxy", "polar")
