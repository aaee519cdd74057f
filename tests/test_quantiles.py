"""Exact quantiles by counted brackets against numpy."""

import numpy as np
import pandas as pd
import pytest

from wardenlake.operators import drift, ordered, profiles

P = {f"q{i}": i / 10 for i in range(11)} | {"p99": 0.99, "third": 1 / 3}


def _parts():
    rng = np.random.default_rng(1)
    return {
        "normal": rng.normal(size=8000), "ties": rng.integers(0, 5, 8000).astype(float), "heavy": np.r_[np.zeros(6000), rng.normal(size=2000)], "wide": np.exp(rng.normal(size=8000) * 50),
        "top": np.r_[rng.normal(size=2000), np.full(6000, 50.0)], "one": np.array([3.0]), "two": np.array([1.0, 2.0]), None: rng.normal(size=500),
    }


@pytest.mark.parametrize("few", [10, 10**6])
def test_brackets_are_exact(spark, few):
    parts = _parts()
    rows = pd.concat([*(pd.DataFrame({"k": [k] * len(v), "x": v}) for k, v in parts.items()), pd.DataFrame({"k": ["bad"] * 3, "x": [np.nan, np.inf, -np.inf]})])
    got = {r["k"]: r for r in ordered.bracketed(spark.createDataFrame(rows, "k string, x double").repartition(8), ["k"], "x", P, few=few).collect()}
    assert set(got) == set(parts)  # a key without a finite value has no row
    for k, v in parts.items():
        assert got[k]["n"] == len(v)
        for name, p in P.items():
            assert got[k][name] == pytest.approx(np.quantile(v, p), rel=1e-9, abs=1e-12)


def test_brackets_without_keys_with_weights_and_empty(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=5000), rng.integers(0, 9, 5000)
    rows = spark.createDataFrame(pd.DataFrame({"x": x, "w": w}))
    assert ordered.bracketed(rows, [], "x", {"m": 0.5}, few=10).first()["m"] == pytest.approx(np.median(x))
    got = ordered.bracketed(rows, [], "x", {"a": 0.3, "b": 0.9}, weight="w", few=10).first()
    whole = np.repeat(x, w)
    assert got["n"] == len(whole) and got["a"] == pytest.approx(np.quantile(whole, 0.3)) and got["b"] == pytest.approx(np.quantile(whole, 0.9))
    assert ordered.bracketed(rows.where("false"), [], "x", {"m": 0.5}).count() == 0


def test_large_groups_take_brackets(spark):
    """ranges above 1: the same five numbers, deviations and PSI as the plain windows, and few rows beyond the cells' counts."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame(pd.DataFrame({"feature": ["a"] * 6000 + ["b"] * 10, "value": rng.normal(size=6010), "is_target": rng.random(6010) < 0.5})).cache()
    for make in (
        lambda r: profiles.five_number(rows, ["feature"], "value", ranges=r), lambda r: ordered.median_mad(rows, ["feature"], "value", ranges=r), lambda r: drift.psi(rows, ranges=r),
    ):
        plain, cut = (make(r).orderBy("feature").toPandas() for r in (1, 5))
        pd.testing.assert_frame_equal(plain, cut)


def test_values_shuffled_are_few(spark):
    """Of 200,000 distinct values the brackets of three quantiles hold under three in a hundred."""
    rows = spark.range(200_000).selectExpr("double(xxhash64(id)) AS __v", "1L AS __w")
    cells = ordered._cells(rows, [], "cells")
    hit = cells.where(" or ".join(f"(__rank0 <= {r} and {r} < __rank0 + __c)" for r in (50_000, 100_000, 150_000)))
    assert cells.count() <= 2 * ordered.CELLS and hit.agg({"__rows": "sum"}).first()[0] < 6_000
