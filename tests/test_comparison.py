"""Models compared by parts and digests."""

import pytest

from wardenlake.operators import comparison

DDL = "m string, kind string, name string, shape array<long>, dtype string, layout string, size long, content string, extra int"


def _parts(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], DDL)


def _tensor(m, name, shape, dtype="F32", size=8, content="aa"):
    return (m, "tensor", name, shape, dtype, None, size, content)


@pytest.fixture(scope="module")
def paired(spark):
    base = [_tensor("a", "w", [2, 2]), _tensor("a", "b", [2]), _tensor("a", "gone", [3]), ("a", "operator", "Conv", None, None, None, 2, None), ("a", "operator", "Relu", None, None, None, 1, None),
            ("a", "input", "x", [1, 3], "F32", "NCHW", None, None), ("a", "preprocessing", "resize_shape", None, None, None, None, "[8,8]"), ("a", "format", "format", None, None, None, None, "onnx")]
    other = [_tensor("a", "w", [2, 3], "f32", 12, "bb"), _tensor("a", "b", [2], "f32", 8, "AA"), _tensor("a", "new", [1]), ("a", "operator", "Conv", None, None, None, 3, None), ("a", "operator", "Add", None, None, None, 1, None),
             ("a", "input", "x", [1, 3], "f32", "NHWC", None, None), ("a", "output", "y", [1], "F32", None, None, None), ("a", "preprocessing", "resize_shape", None, None, None, None, "[9,9]"), ("a", "format", "format", None, None, None, None, "onnx")]
    same = [_tensor(None, "w", [1]), _tensor(None, "w", [1]), (None, "input", "x", [1], "F32", None, None, None)]  # a null key, a part twice
    lone = [_tensor("only", "w", [1])]
    steps = [("s", "preprocessing", "normalization_mean", None, None, None, None, "0.5"), ("s", "input", "x", [1], "F32", None, None, None)]
    return comparison.paired_parts(_parts(spark, base + same + lone + steps), _parts(spark, other + same + steps[1:] + [("a", None, "w", None, None, None, None, None)]), ["m"]).cache()


def test_differences(paired):
    got = {(r["m"], r["path"]): (r["reference_value"], r["candidate_value"], r["severity"], r["reason_code"]) for r in comparison.model_differences(paired, ["m"]).collect()}
    assert got == {
        ("a", "tensors.w.shape"): ("[2,2]", "[2,3]", "HIGH", "TENSOR_SHAPE_MUTATION"), ("a", "tensors.gone"): ("F32 [3]", None, "HIGH", "REMOVED_TENSOR_DETECTED"), ("a", "tensors.new"): (None, "F32 [1]", "HIGH", "ADDED_TENSOR_DETECTED"),
        ("a", "operators.Conv"): ("2", "3", "MEDIUM", "OPERATOR_COUNT_MISMATCH"), ("a", "operators.Relu"): ("1", None, "HIGH", "OPERATOR_PRESENCE_MISMATCH"), ("a", "operators.Add"): (None, "1", "HIGH", "OPERATOR_PRESENCE_MISMATCH"),
        ("a", "inputs.x.layout"): ("NCHW", "NHWC", "MEDIUM", "INPUT_LAYOUT_MUTATION"), ("a", "outputs.y"): (None, "F32 [1]", "HIGH", "ADDED_OUTPUT_CONTRACT"), ("a", "outputs.count"): ("0", "1", "HIGH", "OUTPUT_COUNT_MISMATCH"),
        ("a", "preprocessing.resize_shape"): ("[8,8]", "[9,9]", "HIGH", "PREPROCESSING_RESIZE_MUTATION"),
    }  # fmt: skip  (parameters: 4 + 2 + 3 and 6 + 2 + 1, tensors: 3 and 3)


def test_tiers(spark, paired):
    got = {r["m"]: r for r in comparison.compare_models(paired, ["m"]).collect()}
    a = got["a"]
    assert (a["drift"], a["comparison_status"], a["artifact_status"]) == ("STRUCTURAL_WEIGHT_CONTRACT_DRIFT", "PARTIALLY_COMPARABLE", "ARTIFACT_UNAVAILABLE")
    assert (a["n_unchanged"], a["n_added"], a["n_removed"], a["n_content_and_metadata_changed"], a["n_content_changed"]) == (1, 1, 1, 1, 0)
    assert got[None]["drift"] == "EXACT_INTEGRITY_MATCH" and got[None]["n_unchanged"] == 1
    assert (got["only"]["drift"], got["only"]["comparison_status"]) == ("DRIFT_UNAVAILABLE", "UNCOMPARABLE")
    assert got["s"]["contract_status"] == "CONTRACT_MATCH"  # one side has no steps, so that these aren't compared
    ids = "m string, " + ", ".join(f"{s}_{n} string" for s in ("reference", "candidate") for n in ("artifact", "structure", "weights", "contract", "master", "trust"))
    h = ("1", "2", "3", "4", "5")
    rows = [("a", *h, "VERIFIED", " 1 ", "2", "3", "4", "5", "verified"), (None, *h, "verified", "9", "2", "3", "4", "", " untrusted"), ("new", *h, "corrupted", *h, "invalid"), ("half", "1", None, None, None, None, None, "2", "2", None, None, None, None)]
    got = {r["m"]: r for r in comparison.compare_models(paired, ["m"], spark.createDataFrame(rows, ids)).collect()}
    assert got["a"]["reason_codes"] == sorted({"COMPARABLE", "EXACT_INTEGRITY_MATCH", "EXACT_ARTIFACT_MATCH", "MASTER_FINGERPRINT_MATCH", "STRUCTURE_MATCH", "WEIGHT_MERKLE_MATCH", "CONTRACT_MATCH"})
    assert got[None]["comparison_status"] == "CANDIDATE_UNVERIFIABLE" and "MASTER_FINGERPRINT_MISMATCH" in got[None]["reason_codes"] and got[None]["artifact_status"] == "ARTIFACT_DIFFERENT"
    assert got["new"]["comparison_status"] == "INVALID_REFERENCE" and got["new"]["n_added"] == 0
    assert (got["half"]["comparison_status"], got["half"]["drift"]) == ("PARTIALLY_COMPARABLE", "DRIFT_UNAVAILABLE")


def test_empty_and_without_keys(spark, paired):
    none = comparison.paired_parts(_parts(spark, []), _parts(spark, []), ["m"])
    assert comparison.model_differences(none, ["m"]).count() == 0 and comparison.compare_models(none, ["m"]).count() == 0
    one = comparison.paired_parts(_parts(spark, [_tensor("a", "w", [2])]), _parts(spark, [_tensor("a", "w", [3])]), [])
    assert {r["reason_code"] for r in comparison.model_differences(one, []).collect()} == {"TENSOR_SHAPE_MUTATION", "PARAMETER_COUNT_MISMATCH"}
    assert comparison.compare_models(one, []).first()["weight_status"] == "WEIGHT_DRIFT"
