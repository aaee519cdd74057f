"""Comparison of models by their parts: which tensors, operators, inputs, outputs and preprocessing steps differ, and what that makes of each pair of models.

A side is a long table of parts: keys (which pair of models), kind, name, shape (array of long), dtype, layout, size (a tensor's bytes, an operator's count), content (a tensor's
digest, the text of a step or format). Kinds: format, tensor, operator (structure); input, output, preprocessing (contract). Both sides meet in one aggregation by part, so that no
model is a group of its own; models are summed up from that, and only differences meet the models' flags.

Null keys are keys like others; a part with null kind is left out, one with a null name is a part. Of a part that a side has twice, the greater facts count. Empty sides give no rows or
UNAVAILABLE; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .integrity import drift_class
from .ordered import join_groups

FACTS = ("shape", "dtype", "layout", "size", "content")
STRUCTURE, CONTRACT = ("format", "tensor", "operator"), ("input", "output", "preprocessing")

# Categories, paths and reason codes of differences.
PRESENCE = {  # kind: category, path, code where the candidate alone has the part, code where the reference alone has it
    "tensor": ("tensor_schema", "tensors", "ADDED_TENSOR_DETECTED", "REMOVED_TENSOR_DETECTED"),
    "input": ("input_descriptor", "inputs", "ADDED_INPUT_CONTRACT", "REMOVED_INPUT_CONTRACT"),
    "output": ("output_descriptor", "outputs", "ADDED_OUTPUT_CONTRACT", "REMOVED_OUTPUT_CONTRACT"),
}
MUTATIONS = (  # kind, fact, severity, code
    ("tensor", "shape", "HIGH", "TENSOR_SHAPE_MUTATION"), ("tensor", "dtype", "HIGH", "TENSOR_DTYPE_MUTATION"),
    ("input", "shape", "HIGH", "INPUT_SHAPE_MUTATION"), ("input", "dtype", "HIGH", "INPUT_DTYPE_MUTATION"), ("input", "layout", "MEDIUM", "INPUT_LAYOUT_MUTATION"),
    ("output", "shape", "HIGH", "OUTPUT_SHAPE_MUTATION"), ("output", "dtype", "HIGH", "OUTPUT_DTYPE_MUTATION"),
)
STEPS = {"resize_shape": "PREPROCESSING_RESIZE_MUTATION", "normalization_mean": "PREPROCESSING_MEAN_MUTATION", "normalization_std": "PREPROCESSING_STD_MUTATION"}
TOTALS = (  # name, kind it counts, category, path, code
    ("tensors", "tensor", "tensor_count", "tensor_count", "TENSOR_COUNT_MISMATCH"), ("parameters", "tensor", "parameter_count", "parameter_count", "PARAMETER_COUNT_MISMATCH"),
    ("inputs", "input", "input_count", "inputs.count", "INPUT_COUNT_MISMATCH"), ("outputs", "output", "output_count", "outputs.count", "OUTPUT_COUNT_MISMATCH"),
)
CHANGES = ("UNCHANGED", "ADDED", "REMOVED", "CONTENT_CHANGED", "METADATA_CHANGED", "CONTENT_AND_METADATA_CHANGED")


def paired_parts(reference: DataFrame, candidate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, kind, name, r, c: the facts of either side, null where it lacks the part. One shuffle by part."""
    side = lambda df, is_ref: df.where("kind is not null").select(*keys, "kind", "name", F.struct(*FACTS).alias("facts"), F.lit(is_ref).alias("is_ref"))
    both = side(reference, True).unionByName(side(candidate, False))
    return both.groupBy(*keys, "kind", "name").agg(F.max(F.when(F.col("is_ref"), F.col("facts"))).alias("r"), F.max(F.when(~F.col("is_ref"), F.col("facts"))).alias("c"))


def _text(fact: str, side: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(side[fact], ",", "null"), F.lit("]")) if fact == "shape" else side[fact].cast("string")


def _differs(fact: str) -> Column:
    a, b = F.col("r")[fact], F.col("c")[fact]
    return ~(F.upper(a).eqNullSafe(F.upper(b)) if fact == "dtype" else F.lower(a).eqNullSafe(F.lower(b)) if fact == "content" else a.eqNullSafe(b))


def _row(when: Column, category: str, path: Column, r: Column, c: Column, severity: Column | str, code: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct(F.lit(category).alias("category"), path.alias("path"), r.alias("reference_value"), c.alias("candidate_value"), lit(severity).alias("severity"), lit(code).alias("reason_code")))


def _of_part() -> Column:
    """The differences of one part as an array."""
    kind, r, c = F.col("kind"), F.col("r"), F.col("c")
    both, name = r.isNotNull() & c.isNotNull(), F.coalesce("name", F.lit(""))
    schema = lambda side: F.concat_ws(" ", side["dtype"], _text("shape", side))
    found = [_row((kind == "format") & _differs("content"), "format", F.lit("format"), r["content"], c["content"], "HIGH", "MODEL_FORMAT_MISMATCH")]
    for k, (category, path, added, removed) in PRESENCE.items():
        at = F.concat(F.lit(f"{path}."), name)
        found += [
            _row((kind == k) & r.isNull(), category, at, F.lit(None).cast("string"), schema(c), "HIGH", added),
            _row((kind == k) & c.isNull(), category, at, schema(r), F.lit(None).cast("string"), "HIGH", removed),
        ]
        found += [_row((kind == k) & both & _differs(fact), category, F.concat(at, F.lit(f".{fact}")), _text(fact, r), _text(fact, c), severity, code) for k2, fact, severity, code in MUTATIONS if k2 == k]
    lone = r["size"].isNull() | c["size"].isNull()
    absent = lone | (r["size"] == 0) | (c["size"] == 0)
    severity = F.when(lone, "HIGH").otherwise("MEDIUM")
    code = F.when(absent, "OPERATOR_PRESENCE_MISMATCH").otherwise("OPERATOR_COUNT_MISMATCH")
    found.append(_row((kind == "operator") & _differs("size"), "operator", F.concat(F.lit("operators."), name), _text("size", r), _text("size", c), severity, code))
    step = reduce(lambda x, s: F.when(F.col("name") == s[0], s[1]).otherwise(x), STEPS.items(), F.lit(None).cast("string"))
    found.append(_row((kind == "preprocessing") & step.isNotNull() & _differs("content"), "preprocessing", F.concat(F.lit("preprocessing."), name), r["content"], c["content"], "HIGH", step))
    return F.array_compact(F.array(*found))


def _sides(paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and, of each side, whether it has a structure, a contract and preprocessing, and its totals: one row a pair of models."""
    kind = F.col("kind")
    product = lambda shape: F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * F.coalesce(x.cast("long"), F.lit(1).cast("long")))
    aggs = []
    for s in ("r", "c"):
        has = F.col(s).isNotNull()
        aggs += [F.max(has & kind.isin(*STRUCTURE)).alias(f"{s}_structure"), F.max(has & kind.isin(*CONTRACT)).alias(f"{s}_contract"), F.max(has & (kind == "preprocessing")).alias(f"{s}_steps")]
        aggs += [F.sum((has & (kind == k)).cast("long")).alias(f"{s}_{n}") for n, k, *_ in TOTALS if n != "parameters"]
        aggs.append(F.sum(F.when(has & (kind == "tensor"), F.coalesce(product(F.col(s)["shape"]), F.lit(0).cast("long"))).otherwise(0)).alias(f"{s}_parameters"))
    return paired.groupBy(*keys).agg(*aggs)


def model_differences(paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, category, path, reference_value, candidate_value, severity, reason_code: every difference of structure and contract, in no order. A tier is compared where both sides
    have it, preprocessing where both sides have steps. paired is read twice."""
    sides = _sides(paired, keys)
    parts = paired.select(*keys, F.explode(_of_part()).alias("d"), F.col("kind").isin(*CONTRACT).alias("is_contract"))
    met = join_groups(parts, sides, keys) if keys else parts.crossJoin(F.broadcast(sides))  # without keys: one row
    tier = F.when(~F.col("is_contract"), F.col("r_structure") & F.col("c_structure")).when(F.col("d.category") == "preprocessing", F.col("r_steps") & F.col("c_steps")).otherwise(F.col("r_contract") & F.col("c_contract"))
    totals = F.array_compact(F.array(*(
        _row((F.col(f"r_{n}") != F.col(f"c_{n}")) & F.col(f"r_{t}") & F.col(f"c_{t}"), category, F.lit(path), F.col(f"r_{n}").cast("string"), F.col(f"c_{n}").cast("string"), "HIGH", code)
        for n, k, category, path, code in TOTALS for t in ("structure" if k in STRUCTURE else "contract",)
    )))
    return met.where(tier).select(*keys, "d.*").unionByName(sides.select(*keys, F.explode(totals).alias("d")).select(*keys, "d.*"))


def tensor_change() -> Column:
    """What became of a tensor, of a row of paired_parts; null for other kinds. Metadata: shape, dtype (in any case) and bytes; content: the digest in any case."""
    m, c = _differs("shape") | _differs("dtype") | _differs("size"), _differs("content")
    changed = F.when(m & c, "CONTENT_AND_METADATA_CHANGED").when(c, "CONTENT_CHANGED").when(m, "METADATA_CHANGED").otherwise("UNCHANGED")
    return F.when(F.col("kind") == "tensor", F.when(F.col("r").isNull(), "ADDED").when(F.col("c").isNull(), "REMOVED").otherwise(changed))


def compare_models(paired: DataFrame, keys: Sequence[str], identities: DataFrame | None = None) -> DataFrame:
    """One row a pair of models: comparison_status, drift (one of eight states), artifact_status, structural_status, weight_status, contract_status, reason_codes and a count for each kind of
    tensor change. identities: keys with reference_ and candidate_ artifact, structure, weights, contract, master (digests) and trust, one row a pair; digests that both sides have
    decide a tier, else its parts do. Without identities the artifact is unavailable and both sides count as verified. Pairs that only identities name are compared by digests."""
    kind = F.col("kind")
    steps = kind == "preprocessing"
    rows = paired.withColumn("differs", F.size(_of_part()) > 0).withColumn("change", tensor_change())
    counts = rows.groupBy(*keys).agg(
        *(F.max(F.col(s).isNotNull() & kind.isin(*kinds)).alias(f"{s}_{n}") for s in ("r", "c") for n, kinds in (("structure", STRUCTURE), ("weights", ("tensor",)), ("contract", CONTRACT), ("steps", ("preprocessing",)))),
        F.max(kind.isin(*STRUCTURE) & F.col("differs")).alias("d_structure"), F.max(kind.isin(*CONTRACT) & ~steps & F.col("differs")).alias("d_contract"), F.max(steps & F.col("differs")).alias("d_steps"),
        F.max(F.col("change").isNotNull() & (F.col("change") != "UNCHANGED")).alias("d_weights"), *(F.sum(F.coalesce((F.col("change") == x).cast("long"), F.lit(0))).alias(f"n_{x.lower()}") for x in CHANGES),
    )
    tiers = ("artifact", "structure", "weights", "contract", "master")
    given = [f"{s}_{n}" for s in ("reference", "candidate") for n in (*tiers, "trust")]
    if identities is None:
        out = counts.withColumns({n: F.lit(None).cast("string") for n in given})
    elif keys:
        named = identities.select(*(F.col(k).alias(f"__i{i}") for i, k in enumerate(keys)), *given)
        on = [F.col(k).eqNullSafe(F.col(f"__i{i}")) for i, k in enumerate(keys)]
        flagged = counts.withColumn("__here", F.lit(True)).join(named.withColumn("__named", F.lit(True)), on, "full_outer")
        out = flagged.withColumns({k: F.when(F.col("__here"), F.col(k)).otherwise(F.col(f"__i{i}")) for i, k in enumerate(keys)})
    else:
        out = counts.crossJoin(F.broadcast(identities.select(*given)))  # one row each
    off = lambda c: F.coalesce(c, F.lit(False))
    by_parts = {
        "structure": F.when(off(F.col("r_structure") & F.col("c_structure")), F.col("d_structure")), "weights": F.when(off(F.col("r_weights") & F.col("c_weights")), F.col("d_weights")),
        "contract": F.when(off(F.col("r_contract") & F.col("c_contract")), F.col("d_contract") | (F.col("d_steps") & F.col("r_steps") & F.col("c_steps"))),
    }
    clean = lambda n: F.nullif(F.lower(F.trim(F.col(n))), F.lit(""))
    drifted = {n: F.coalesce(clean(f"reference_{n}") != clean(f"candidate_{n}"), by_parts.get(n, F.lit(None).cast("boolean"))) for n in tiers}
    status = lambda n, same, apart, none: F.when(F.col(f"x_{n}").isNull(), none).when(F.col(f"x_{n}"), apart).otherwise(same)
    out = out.withColumns({f"x_{n}": d for n, d in drifted.items()}).withColumns({
        "artifact_status": status("artifact", "ARTIFACT_MATCH", "ARTIFACT_DIFFERENT", "ARTIFACT_UNAVAILABLE"), "structural_status": status("structure", "STRUCTURE_MATCH", "STRUCTURAL_DRIFT", "STRUCTURE_UNAVAILABLE"),
        "weight_status": status("weights", "WEIGHT_MERKLE_MATCH", "WEIGHT_DRIFT", "WEIGHT_COMPARISON_UNAVAILABLE"), "contract_status": status("contract", "CONTRACT_MATCH", "CONTRACT_DRIFT", "CONTRACT_COMPARISON_UNAVAILABLE"),
        "drift": drift_class(F.col("x_structure"), F.col("x_weights"), F.col("x_contract")),
    })
    trust = lambda s, *words: off(F.upper(F.trim(F.col(f"{s}_trust"))).isin(*words))
    missing = sum((F.col(f"x_{n}").isNull().cast("int") for n in tiers[:4]), F.lit(0))
    known = (
        F.when(trust("reference", "INVALID", "CORRUPTED"), "INVALID_REFERENCE").when(trust("candidate", "INVALID", "CORRUPTED"), "INVALID_CANDIDATE").when(trust("reference", "UNVERIFIABLE", "UNTRUSTED"), "REFERENCE_UNVERIFIABLE")
        .when(trust("candidate", "UNVERIFIABLE", "UNTRUSTED"), "CANDIDATE_UNVERIFIABLE").when(missing == 4, "UNCOMPARABLE").when(missing > 0, "PARTIALLY_COMPARABLE").otherwise("COMPARABLE")
    )
    out = out.withColumn("comparison_status", known)
    exact = lambda n, yes, no: F.when(off(~F.col(f"x_{n}")), yes).otherwise(no)
    codes = F.array("comparison_status", "drift", exact("artifact", "EXACT_ARTIFACT_MATCH", "ARTIFACT_BYTES_DIFFER"), exact("master", "MASTER_FINGERPRINT_MATCH", "MASTER_FINGERPRINT_MISMATCH"), "structural_status", "weight_status", "contract_status")
    tallies = [F.coalesce(f"n_{x.lower()}", F.lit(0)).cast("long").alias(f"n_{x.lower()}") for x in CHANGES]
    return out.select(*keys, "comparison_status", "drift", "artifact_status", "structural_status", "weight_status", "contract_status", F.array_sort(F.array_distinct(codes)).alias("reason_codes"), *tallies)
