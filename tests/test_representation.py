"""Representation drift of several models at once against all pairs."""

import numpy as np
import pytest

from wardenlake.operators import representation

DDL = "m string, is_target boolean, e array<float>, extra int"


def _rows():
    rng = np.random.default_rng(5)
    rows, kept = [], {}
    for m, n, shift in (("moved", 300, 0.8), ("same", 400, 0.0), (None, 120, 0.8), ("few", 10, 0.0)):
        x, y = rng.normal(size=(n, 6)) + 1, rng.normal(size=(n + 20 if m != "few" else 50, 6)) + 1
        y[:, 0] += 3 * shift
        kept[m] = (x, y)
        rows += [(m, False, v.tolist(), 1) for v in x] + [(m, True, v.tolist(), 1) for v in y]
    bad = [None, [0.0] * 6, [1.0] * 5, [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [None] + [1.0] * 5, []]
    return rows + [("moved", False, b, 1) for b in bad] + [("moved", None, [1.0] * 6, 1), ("none", True, None, 1)], kept


def _exact(x, y, gamma):
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    d2 = lambda a, b: np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)
    k, d = (lambda a, b: np.exp(-gamma * d2(a, b)).mean()), (lambda a, b: np.sqrt(d2(a, b)).mean())
    return k(x, x) + k(y, y) - 2 * k(x, y), 2 * d(x, y) - d(x, x) - d(y, y)


def test_many_models(spark):
    rows, kept = _rows()
    df = spark.createDataFrame(rows, DDL).repartition(6)
    got = {r["m"]: r for r in representation.representation_drift(df, ["m"], "e", 6, directions=64).collect()}
    assert set(got) == {"moved", "same", None, "few", "none"}
    a = got["moved"]
    assert (a["reference_total"], a["reference_valid"], a["reference_failed"], a["reference_invalid"], a["target_total"]) == (307, 300, 2, 5, 320)
    assert {m: got[m]["status"] for m in ("few", "none")} == {"few": "INSUFFICIENT_DATA", "none": "INSUFFICIENT_DATA"} and got["few"]["mmd2"] is None and got["none"]["target_failed"] == 1
    for m in ("moved", "same", None):
        mmd2, energy = _exact(*kept[m], got[m]["gamma"])
        assert abs(got[m]["mmd2"] - mmd2) <= 5 * got[m]["error"] + 1e-3
        assert got[m]["energy"] == pytest.approx(energy, rel=0.35, abs=0.01)
    assert (a["status"], a["severity"], a["confidence"]) == ("MATERIAL_SHIFT", "high", 0.95) == (got[None]["status"], got[None]["severity"], got[None]["confidence"])
    assert got["same"]["status"] == "NO_SHIFT_DETECTED" and got["same"]["p_value"] > 0.05 and got["same"]["severity"] == "info"


def test_without_keys_and_empty(spark):
    rows, kept = _rows()
    df = spark.createDataFrame([r for r in rows if r[0] == "moved"], DDL)
    got = representation.representation_drift(df, [], "e", 6, normalize=False, features=128, permutations=20, directions=8).collect()
    assert len(got) == 1 and got[0]["status"] == "MATERIAL_SHIFT" and got[0]["reference_valid"] == 301  # a vector of zeros is valid unless lengths are made one
    assert representation.representation_drift(df.where("false"), ["m"], "e", 6).count() == 0
