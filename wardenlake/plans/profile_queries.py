"""Queries of output profiles, joint drift, time accounting and records kept as maps or JSON texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..operators import comparison, drift, inference, integrity, outputs, risk
from .assurance_queries import _EVID, _KEY, _evidence
from .drift_queries import _flag
from .system_queries import _BOX, _boxes
from .vector_queries import _halves

NUMBERS = ("min", "max", "mean", "std", "p25", "median", "p75", "p95")


def _rounded(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


def detection_profile(spark, d):
    """Orders as images, their line items as boxes."""
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return _rounded(outputs.detection_profile(images, _boxes(spark, d, 0.0), "l_orderkey"), *NUMBERS, "zero_share")


def detection_classes(spark, d):
    return outputs.class_frequency(_boxes(spark, d, 0.0))


def segmentation_profile(spark, d):
    """Embeddings' components as pixels, classed by two cuts as two models' masks."""
    cls = lambda x, at: F.when(x > 0.1, 2).when(x > at, 1).otherwise(0)
    m = table(spark, d, "embeddings").select(F.transform("embedding", lambda x: cls(x, 0.0)).alias("a"), F.transform("embedding", lambda x: cls(x, -0.02)).alias("b"))
    return _rounded(outputs.segmentation_profile(m, "a", inference.mask_agreement(F.col("a"), F.col("b"), 3)["mean_iou"]), "share", "mean_iou")


def latency_profile(spark, d):
    runs = table(spark, d, "events").select(F.col("event_type").alias("execution_provider"), F.concat(F.lit("d"), F.col("user_id") % 3).alias("device"), "value")
    return _rounded(outputs.latency_profile(runs, "value"), *NUMBERS)


def _joint(spark, d):
    items = table(spark, d, "lineitem").withColumn("is_target", _flag()).where("is_target is not null")
    long = drift.melt(items, F.col("is_target"), ["l_quantity", "l_discount", "l_tax"])
    labels = items.select("is_target", F.explode(F.array(F.struct(F.lit("status").alias("feature"), F.col("l_linestatus").alias("label")), F.struct(F.lit("line").alias("feature"), F.col("l_linenumber").cast("string").alias("label")))).alias("x")).select("is_target", "x.feature", "x.label")
    return outputs.joint_drift(long, labels)


def joint_drift(spark, d):
    return _rounded(_joint(spark, d), "statistic", "p_value", "adjusted_p")


def global_drift(spark, d):
    return outputs.global_drift(_joint(spark, d))


def novelty_shift(spark, d):
    x, y = _halves(spark, d)
    return _rounded(outputs.novelty_shift(x, y), "mmd", "energy", "p_value")


def time_accounting(spark, d):
    """Events' times as texts, some gone, some broken; late is more than ten days before the newest of the type."""
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_type", F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, F.lit("no time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("raw"))
    return outputs.time_accounting(e, "raw", F.try_to_timestamp("raw", F.lit("yyyy-MM-dd HH:mm:ss")), ["event_type"], 864_000)


def canonical_seconds(spark, d):
    return table(spark, d, "events").select("event_id", outputs.canonical_second(F.col("ts")).alias("time"))


def duplicate_json_keys(spark, d):
    more = F.when(F.col("event_id") % 7 == 0, F.regexp_replace("props", r"\}$", ', "k": 0}')).when(F.col("event_id") % 11 == 0, F.lit("[1]")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", outputs.has_duplicate_keys(more).alias("twice"))


def metadata_maps(spark, d):
    """Two records of a part as maps: equal whatever the order, merged, entries by key."""
    p = table(spark, d, "part")
    text = lambda c: F.col(c).cast("string")
    a = F.create_map(F.lit("type"), text("p_type"), F.lit("brand"), text("p_brand"))
    b = F.create_map(F.lit("brand"), F.when(F.col("p_partkey") % 3 == 0, F.lit("none")).otherwise(text("p_brand")), F.lit("type"), text("p_type"))
    size = F.create_map(F.lit("size"), text("p_size"), F.lit("brand"), F.lit("own"))
    items = F.array_join(F.transform(outputs.sorted_items(outputs.merged(a, size)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return p.select("p_partkey", outputs.same_map(a, b).alias("same"), items.alias("items"))


def hierarchical_risk(spark, d):
    a = risk.asset_risk(_evidence(spark, d), weights=risk.SEVERITY_BY_CLASS).withColumn("role", F.lit("CORE_DEPLOYED"))
    return outputs.hierarchy(a, risk.project_risk(a))


def model_comparison(spark, d):
    """Two snapshots of parts as operators: structure, weights and contract differ by name; one state for each brand as a model."""
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").cast("string").alias("name"), "p_size", "p_type", "p_name")
    k = F.col("name").cast("long")
    q = p.where(k % 97 != 0).withColumn("p_size", F.when(k % 89 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn("p_name", F.when(k % 83 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).withColumn("p_type", F.when(k % 101 == 0, F.lit("other")).otherwise(F.col("p_type")))
    both = p.alias("a").join(q.alias("b"), F.col("a.name") == F.col("b.name"), "full_outer")
    gone = F.col("a.name").isNull() | F.col("b.name").isNull()
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    per = both.groupBy(F.coalesce("a.p_brand", "b.p_brand").alias("model")).agg(F.max(gone | differs("p_size")).alias("s"), F.max(~gone & differs("p_name")).alias("w"), F.max(~gone & differs("p_type")).alias("c"), F.sum(gone.cast("long")).alias("n_gone"))
    return per.select("model", "n_gone", integrity.drift_class(F.col("s"), F.col("w"), F.col("c")).alias("state"))


def _parts(p):
    """A brand's parts as a model: a tensor each, operators by container, inputs by size, one output, a step."""
    none, nothing, text = F.lit(None).cast("array<long>"), F.lit(None).cast("string"), lambda c: F.col(c).cast("string")
    out = lambda df, kind, name, shape=none, dtype=nothing, layout=nothing, size=F.lit(None).cast("long"), content=nothing: df.select(
        F.col("p_brand").alias("model"), F.lit(kind).alias("kind"), name.alias("name"), shape.alias("shape"), dtype.alias("dtype"), layout.alias("layout"), size.alias("size"), content.alias("content"))
    ops, ins, all_ = p.groupBy("p_brand", "p_type").count(), p.groupBy("p_brand", (F.col("p_size") % 4).alias("port")).agg(F.max("p_partkey").alias("k"), F.max("p_type").alias("t")), p.groupBy("p_brand").agg(F.max("p_size").alias("s"), F.count("*").alias("n"))
    return [
        out(p, "tensor", text("p_partkey"), F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 3 + 1), F.col("p_type"), size=F.col("p_size") * F.lit(4).cast("long"), content=F.sha2("p_name", 256)),
        out(ops, "operator", F.col("p_type"), size=F.col("count")), out(ins, "input", text("port"), F.array("k"), F.col("t"), F.when(F.col("k") % 2 == 0, "NCHW").otherwise("NHWC")),
        out(all_, "output", F.lit("scores"), F.array(F.col("s").cast("long")), F.lit("F32")), out(all_, "preprocessing", F.lit("resize_shape"), content=text("n")),
    ]


def _models(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    q = p.where((k % 97 != 0) & (k % 25 != 3)).withColumns({
        "p_size": F.when(k % 89 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")), "p_name": F.when(k % 83 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")),
        "p_type": F.when(k % 101 == 0, F.lit("other")).otherwise(F.lower("p_type")), "p_partkey": F.when(k % 103 == 0, -k).otherwise(k),
    })
    union = lambda parts: parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])
    return comparison.paired_parts(union(_parts(p)), union(_parts(q)), ["model"])


def model_differences(spark, d):
    """Every difference of structure and contract between two snapshots of each brand as a model."""
    return comparison.model_differences(_models(spark, d), ["model"])


def model_tiers(spark, d):
    """The same models by tier: statuses, one of eight states, codes and counts of tensor changes."""
    out = comparison.compare_models(_models(spark, d), ["model"])
    return out.withColumn("reason_codes", F.array_join("reason_codes", ","))


QUERIES = {
    "detection_profile": detection_profile, "detection_classes": detection_classes, "segmentation_profile": segmentation_profile, "latency_profile": latency_profile, "joint_drift": joint_drift,
    "global_drift": global_drift, "novelty_shift": novelty_shift, "time_accounting": time_accounting, "canonical_seconds": canonical_seconds, "duplicate_json_keys": duplicate_json_keys,
    "metadata_maps": metadata_maps, "hierarchical_risk": hierarchical_risk, "model_comparison": model_comparison, "model_differences": model_differences, "model_tiers": model_tiers,
}

_FIVE = """count(*) AS n, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.25), 6) AS p25, round(median(x), 6) AS median,
  round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.95), 6) AS p95"""
_SEVC = "CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.4 ELSE 0.2 END"
_LEVEL = "CASE WHEN risk >= 0.85 THEN 'CRITICAL' WHEN risk >= 0.65 THEN 'HIGH' WHEN risk >= 0.3 THEN 'MEDIUM' WHEN risk > 0 THEN 'LOW' ELSE 'NONE' END"

_MODELS = """p AS (SELECT p_brand AS model, p_partkey AS k, p_size AS sz, p_type AS ty, p_name AS nm FROM part),
q AS (SELECT p_brand AS model, CASE WHEN p_partkey % 103 = 0 THEN -p_partkey ELSE p_partkey END AS k, CASE WHEN p_partkey % 89 = 0 THEN p_size + 1 ELSE p_size END AS sz, CASE WHEN p_partkey % 101 = 0 THEN 'other' ELSE lower(p_type) END AS ty,
  CASE WHEN p_partkey % 83 = 0 THEN p_name || '!' ELSE p_name END AS nm FROM part WHERE p_partkey % 97 <> 0 AND p_partkey % 25 <> 3),
b AS (SELECT 'r' AS side, * FROM p UNION ALL SELECT 'c', * FROM q),
t AS (SELECT side, model, k::VARCHAR AS name, '[' || sz || ',' || (k % 3 + 1) || ']' AS shape, sz * (k % 3 + 1) AS params, ty AS dtype, sha256(nm) AS content FROM b),
o AS (SELECT side, model, ty AS name, count(*) AS n FROM b GROUP BY ALL), i AS (SELECT side, model, (sz % 4)::VARCHAR AS name, '[' || max(k) || ']' AS shape, max(ty) AS dtype, CASE WHEN max(k) % 2 = 0 THEN 'NCHW' ELSE 'NHWC' END AS layout FROM b GROUP BY ALL),
a AS (SELECT side, model, '[' || max(sz) || ']' AS shape, count(*)::VARCHAR AS n FROM b GROUP BY ALL),
tt AS (SELECT coalesce(x.model, y.model) AS model, coalesce(x.name, y.name) AS name, x.name IS NULL AS added, y.name IS NULL AS removed, x.shape AS rs, y.shape AS cs, x.dtype AS rd, y.dtype AS cd, x.content <> y.content AS cc FROM (SELECT * FROM t WHERE side = 'r') x FULL JOIN (SELECT * FROM t WHERE side = 'c') y USING (model, name)),
oo AS (SELECT coalesce(x.model, y.model) AS model, coalesce(x.name, y.name) AS name, x.n AS r, y.n AS c FROM (SELECT * FROM o WHERE side = 'r') x FULL JOIN (SELECT * FROM o WHERE side = 'c') y USING (model, name)),
ii AS (SELECT coalesce(x.model, y.model) AS model, coalesce(x.name, y.name) AS name, x.shape AS rs, y.shape AS cs, x.dtype AS rd, y.dtype AS cd, x.layout AS rl, y.layout AS cl, x.name IS NULL AS added, y.name IS NULL AS removed FROM (SELECT * FROM i WHERE side = 'r') x FULL JOIN (SELECT * FROM i WHERE side = 'c') y USING (model, name)),
aa AS (SELECT model, x.shape AS rs, y.shape AS cs, x.n AS rn, y.n AS cn FROM (SELECT * FROM a WHERE side = 'r') x JOIN (SELECT * FROM a WHERE side = 'c') y USING (model)),
m AS (SELECT model, count(*) FILTER (side = 'r') AS rt, count(*) FILTER (side = 'c') AS ct, sum(params) FILTER (side = 'r') AS rp, sum(params) FILTER (side = 'c') AS cp FROM t GROUP BY 1),
n AS (SELECT model, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'c') AS c FROM i GROUP BY 1),
f AS (SELECT model, 'tensor_schema' AS category, 'tensors.' || name AS path, NULL AS reference_value, cd || ' ' || cs AS candidate_value, 'HIGH' AS severity, 'ADDED_TENSOR_DETECTED' AS reason_code FROM tt WHERE added
UNION ALL SELECT model, 'tensor_schema', 'tensors.' || name, rd || ' ' || rs, NULL, 'HIGH', 'REMOVED_TENSOR_DETECTED' FROM tt WHERE removed
UNION ALL SELECT model, 'tensor_schema', 'tensors.' || name || '.shape', rs, cs, 'HIGH', 'TENSOR_SHAPE_MUTATION' FROM tt WHERE rs <> cs UNION ALL SELECT model, 'tensor_schema', 'tensors.' || name || '.dtype', rd, cd, 'HIGH', 'TENSOR_DTYPE_MUTATION' FROM tt WHERE upper(rd) <> upper(cd)
UNION ALL SELECT model, 'operator', 'operators.' || name, r::VARCHAR, c::VARCHAR, CASE WHEN r IS NULL OR c IS NULL THEN 'HIGH' ELSE 'MEDIUM' END, CASE WHEN r IS NULL OR c IS NULL THEN 'OPERATOR_PRESENCE_MISMATCH' ELSE 'OPERATOR_COUNT_MISMATCH' END FROM oo WHERE r IS DISTINCT FROM c
UNION ALL SELECT model, 'input_descriptor', 'inputs.' || name, NULL, cd || ' ' || cs, 'HIGH', 'ADDED_INPUT_CONTRACT' FROM ii WHERE added UNION ALL SELECT model, 'input_descriptor', 'inputs.' || name, rd || ' ' || rs, NULL, 'HIGH', 'REMOVED_INPUT_CONTRACT' FROM ii WHERE removed
UNION ALL SELECT model, 'input_descriptor', 'inputs.' || name || '.shape', rs, cs, 'HIGH', 'INPUT_SHAPE_MUTATION' FROM ii WHERE rs <> cs UNION ALL SELECT model, 'input_descriptor', 'inputs.' || name || '.dtype', rd, cd, 'HIGH', 'INPUT_DTYPE_MUTATION' FROM ii WHERE upper(rd) <> upper(cd)
UNION ALL SELECT model, 'input_descriptor', 'inputs.' || name || '.layout', rl, cl, 'MEDIUM', 'INPUT_LAYOUT_MUTATION' FROM ii WHERE rl <> cl
UNION ALL SELECT model, 'output_descriptor', 'outputs.scores.shape', rs, cs, 'HIGH', 'OUTPUT_SHAPE_MUTATION' FROM aa WHERE rs <> cs UNION ALL SELECT model, 'preprocessing', 'preprocessing.resize_shape', rn, cn, 'HIGH', 'PREPROCESSING_RESIZE_MUTATION' FROM aa WHERE rn <> cn
UNION ALL SELECT model, 'tensor_count', 'tensor_count', rt::VARCHAR, ct::VARCHAR, 'HIGH', 'TENSOR_COUNT_MISMATCH' FROM m WHERE rt <> ct AND ct > 0 UNION ALL SELECT model, 'parameter_count', 'parameter_count', rp::BIGINT::VARCHAR, cp::BIGINT::VARCHAR, 'HIGH', 'PARAMETER_COUNT_MISMATCH' FROM m WHERE rp <> cp AND ct > 0
UNION ALL SELECT model, 'input_count', 'inputs.count', r::VARCHAR, c::VARCHAR, 'HIGH', 'INPUT_COUNT_MISMATCH' FROM n WHERE r <> c AND c > 0)"""

SQL = {
    "model_differences": f"WITH {_MODELS} SELECT f.* FROM f JOIN m USING (model) WHERE rt > 0 AND ct > 0",
    "model_tiers": f"""WITH {_MODELS}, g AS (SELECT model, CASE WHEN added THEN 'ADDED' WHEN removed THEN 'REMOVED' WHEN cc AND (rs <> cs OR upper(rd) <> upper(cd)) THEN 'CONTENT_AND_METADATA_CHANGED' WHEN cc THEN 'CONTENT_CHANGED' WHEN rs <> cs OR upper(rd) <> upper(cd) THEN 'METADATA_CHANGED' ELSE 'UNCHANGED' END AS change FROM tt),
u AS (SELECT model, count(*) FILTER (change = 'UNCHANGED') AS n_unchanged, count(*) FILTER (change = 'ADDED') AS n_added, count(*) FILTER (change = 'REMOVED') AS n_removed, count(*) FILTER (change = 'CONTENT_CHANGED') AS n_content_changed, count(*) FILTER (change = 'METADATA_CHANGED') AS n_metadata_changed,
  count(*) FILTER (change = 'CONTENT_AND_METADATA_CHANGED') AS n_content_and_metadata_changed, bool_or(change <> 'UNCHANGED') AS w FROM g GROUP BY 1),
h AS (SELECT model, coalesce(bool_or(category IN ('tensor_schema', 'operator')), FALSE) AS s, coalesce(bool_or(category IN ('input_descriptor', 'output_descriptor', 'preprocessing')), FALSE) AS c FROM m LEFT JOIN f USING (model) GROUP BY 1),
v AS (SELECT u.*, s, c, ct > 0 AND rt > 0 AS ok FROM u JOIN h USING (model) JOIN m USING (model)),
x AS (SELECT *, CASE WHEN ok THEN 'PARTIALLY_COMPARABLE' ELSE 'UNCOMPARABLE' END AS comparison_status, CASE WHEN NOT ok THEN 'STRUCTURE_UNAVAILABLE' WHEN s THEN 'STRUCTURAL_DRIFT' ELSE 'STRUCTURE_MATCH' END AS structural_status,
  CASE WHEN NOT ok THEN 'WEIGHT_COMPARISON_UNAVAILABLE' WHEN w THEN 'WEIGHT_DRIFT' ELSE 'WEIGHT_MERKLE_MATCH' END AS weight_status, CASE WHEN NOT ok THEN 'CONTRACT_COMPARISON_UNAVAILABLE' WHEN c THEN 'CONTRACT_DRIFT' ELSE 'CONTRACT_MATCH' END AS contract_status,
  CASE WHEN NOT ok THEN 'DRIFT_UNAVAILABLE' WHEN s AND w AND c THEN 'STRUCTURAL_WEIGHT_CONTRACT_DRIFT' WHEN s AND w THEN 'STRUCTURAL_AND_WEIGHT_DRIFT' WHEN s AND c THEN 'STRUCTURAL_AND_CONTRACT_DRIFT' WHEN w AND c THEN 'WEIGHT_AND_CONTRACT_DRIFT' WHEN s THEN 'STRUCTURAL_ONLY_DRIFT' WHEN w THEN 'WEIGHT_ONLY_DRIFT'
    WHEN c THEN 'CONTRACT_ONLY_DRIFT' ELSE 'EXACT_INTEGRITY_MATCH' END AS drift FROM v)
SELECT model, comparison_status, drift, 'ARTIFACT_UNAVAILABLE' AS artifact_status, structural_status, weight_status, contract_status, n_unchanged, n_added, n_removed, n_content_changed, n_metadata_changed, n_content_and_metadata_changed,
  array_to_string(list_sort(list_distinct([comparison_status, drift, 'ARTIFACT_BYTES_DIFFER', 'MASTER_FINGERPRINT_MISMATCH', structural_status, weight_status, contract_status])), ',') AS reason_codes FROM x""",
    "detection_profile": f"""WITH {_BOX}, c AS (SELECT o_orderkey, count(l_orderkey)::DOUBLE AS x FROM orders LEFT JOIN bx ON l_orderkey = o_orderkey GROUP BY 1), m AS (SELECT 'count' AS measure, x FROM c UNION ALL SELECT 'area', greatest(0.0, (x2 - x1) * (y2 - y1)) FROM bx UNION ALL SELECT 'confidence', 1 - l_discount - l_partkey / 1e7 - l_suppkey / 1e9 FROM lineitem)
SELECT measure, {_FIVE}, round(avg((x = 0)::INTEGER), 6) AS zero_share FROM m GROUP BY 1""",
    "detection_classes": f"WITH {_BOX} SELECT label::VARCHAR AS label, count(*) AS n FROM bx GROUP BY 1",
    "segmentation_profile": """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN 2 WHEN x > 0.0 THEN 1 ELSE 0 END) AS a, list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN 2 WHEN x > -0.02 THEN 1 ELSE 0 END) AS b FROM embeddings),
u AS (SELECT vec_id, unnest(a) AS p, unnest(b) AS q FROM m), c AS (SELECT vec_id, k, count(*) FILTER (p = k AND q = k) AS i, count(*) FILTER (p = k OR q = k) AS o FROM u, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL), j AS (SELECT vec_id, avg(i::DOUBLE / o) FILTER (o > 0) AS iou FROM c GROUP BY 1)
SELECT p AS class, count(*) AS n_pixels, round(count(*)::DOUBLE / (SELECT count(*) FROM u), 6) AS share, (SELECT count(*) FROM m) AS n_masks, 'REFERENCE_MASK_AGREEMENT' AS evaluation_case, (SELECT round(avg(iou), 6) FROM j) AS mean_iou FROM u GROUP BY 1""",
    "latency_profile": f"WITH e AS (SELECT event_type AS execution_provider, 'd' || (user_id % 3) AS device, value AS x FROM events) SELECT execution_provider, device, {_FIVE} FROM e GROUP BY 1, 2",
    "time_accounting": """WITH e AS (SELECT event_type, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN NULL ELSE date_trunc('second', ts) END AS t, event_id % 13 = 0 AS mi FROM events), m AS (SELECT *, max(t) OVER (PARTITION BY event_type) - t > INTERVAL 10 DAY AS late FROM e)
SELECT event_type, count(*) AS n, count(*) FILTER (mi) AS n_missing, count(*) FILTER (NOT mi AND t IS NULL) AS n_invalid, count(*) FILTER (late) AS n_late, count(*) FILTER (t IS NOT NULL AND NOT late) AS n_valid FROM m GROUP BY 1""",
    "canonical_seconds": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time FROM events",
    "duplicate_json_keys": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN TRUE WHEN event_id % 11 = 0 THEN NULL ELSE FALSE END AS twice FROM events",
    "metadata_maps": "SELECT p_partkey, p_partkey % 3 <> 0 AS same, 'brand=own;size=' || p_size || ';type=' || p_type AS items FROM part",
    "hierarchical_risk": f"""WITH {_EVID}, tm AS (SELECT project_id, asset_id, {_KEY} AS cl, least(1.0, {_SEVC} * coalesce(confidence, CASE WHEN layer = 'PROOF' THEN 1.0 ELSE 0.9 END)) AS t FROM e), cs AS (SELECT project_id, asset_id, cl, round((least(1.0, max(t) + 0.15 * (sum(t) - max(t))))::DECIMAL(28, 12), 6)::DOUBLE AS s FROM tm GROUP BY ALL),
ar AS (SELECT project_id, asset_id, round((least(1.0, greatest(0.0, 1 - product(1 - s))))::DECIMAL(28, 12), 6)::DOUBLE AS risk, NOT bool_or(starts_with(cl, 'ev_ind_')) AS ok FROM cs GROUP BY ALL),
pr AS (SELECT project_id, round((greatest(0.0, least(1.0, 1 - pow(1 - max(risk), 1.5) * product(1 - 0.1 * risk))))::DECIMAL(28, 12), 6)::DOUBLE AS risk, bool_and(ok) AS ok FROM ar GROUP BY 1), x AS (SELECT 'ASSET' AS tier, project_id, asset_id, risk, ok FROM ar UNION ALL SELECT 'PROJECT', project_id, NULL, risk, ok FROM pr)
SELECT tier, project_id, asset_id, risk, {_LEVEL} AS level, CASE WHEN ok THEN 'SUFFICIENT' ELSE 'INSUFFICIENT_ANCESTRY' END AS sufficiency FROM x""",
    "model_comparison": """WITH x AS (SELECT p_brand AS model, p_partkey % 97 = 0 AS gone, p_partkey % 89 = 0 AS s, p_partkey % 83 = 0 AS w, p_partkey % 101 = 0 AS c FROM part), m AS (SELECT model, bool_or(gone OR s) AS s, bool_or(NOT gone AND w) AS w, bool_or(NOT gone AND c) AS c, count(*) FILTER (gone) AS n_gone FROM x GROUP BY 1)
SELECT model, n_gone, CASE WHEN NOT s AND NOT w AND NOT c THEN 'EXACT_INTEGRITY_MATCH' WHEN NOT s AND w AND NOT c THEN 'WEIGHT_ONLY_DRIFT' WHEN s AND NOT w AND NOT c THEN 'STRUCTURAL_ONLY_DRIFT' WHEN NOT s AND NOT w AND c THEN 'CONTRACT_ONLY_DRIFT'
  WHEN s AND w AND NOT c THEN 'STRUCTURAL_AND_WEIGHT_DRIFT' WHEN s AND NOT w AND c THEN 'STRUCTURAL_AND_CONTRACT_DRIFT' WHEN NOT s AND w AND c THEN 'WEIGHT_AND_CONTRACT_DRIFT' ELSE 'STRUCTURAL_WEIGHT_CONTRACT_DRIFT' END AS state FROM m""",
}
