"""Queries of trigger activation: decisions by every criterion, rates under trigger and controls, and the whole analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..operators import activation
from ..operators.activation import CONDITIONS

TARGET = 3


def _outputs(spark, d):
    """Each vector's first ten components as a model's output, for each label as a candidate trigger. The trigger lifts the target by a fifth (by a half for even
    labels), location shuffling lifts another component, noise lifts another by less."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("candidate"), F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("clean"))
    lift = F.when(F.col("candidate") % 2 == 0, 0.5).otherwise(0.2)
    e = e.withColumn("condition", F.explode(F.array(*(F.lit(c) for c in CONDITIONS))))
    at = F.when(F.col("condition") == "trigger", F.lit(TARGET)).when(F.col("condition") == "shuffled", F.col("vec_id") % 10).otherwise(F.col("vec_id") * 7 % 10)
    by = F.when(F.col("condition") == "trigger", lift).when(F.col("condition") == "shuffled", 0.125).otherwise(0.0625)
    return e.withColumn("at", at).withColumn("by", by).withColumn("output", F.transform("clean", lambda x, i: F.when(i == F.col("at"), x + F.col("by")).otherwise(x))).drop("at", "by")


def trigger_decisions(spark, d):
    """Classification and tensor criteria; each tenth vector's output is not finite, each eleventh's missing."""
    k = F.col("vec_id")
    rows = _outputs(spark, d).withColumn("output", F.when(k % 11 == 0, F.lit(None)).when(k % 10 == 0, F.transform("output", lambda x, i: F.when(i == 0, float("nan")).otherwise(x))).otherwise(F.col("output")))
    a, b = F.col("clean"), F.col("output")
    made = {"PREDICTION_CHANGED": activation.prediction_changed(a, b, TARGET), "TARGET_MATCHED": activation.target_matched(a, b, TARGET), "CONFIDENCE_DELTA_THRESHOLD": activation.confidence_drop(a, b, 0.1, TARGET), "TENSOR_DISTANCE_THRESHOLD": activation.tensor_distance(a, b, 0.1)}
    every = F.explode(F.array(*(F.struct(F.lit(n).alias("criterion"), c.alias("x")) for n, c in made.items()))).alias("e")
    return rows.select("vec_id", "condition", every).select("vec_id", "condition", "e.criterion", "e.x.decision", "e.x.status", F.round("e.x.value", 6).alias("value"), "e.x.target_matched")


def detection_decisions(spark, d):
    """Orders' lines as boxes of the clean input; under the condition lines of each seventh part are gone and those of each eleventh are another class."""
    i = table(spark, d, "lineitem")
    k, label = F.col("l_partkey"), F.col("l_linenumber") % 3
    x, y = (k % 50).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    box = lambda c: F.struct(F.array(x, y, x + F.col("l_quantity") + 5, y + F.col("l_quantity") + 8).alias("box"), c.alias("label"), (1 - F.col("l_discount")).alias("score"))
    both = i.groupBy("l_orderkey").agg(F.collect_list(box(label)).alias("clean"), F.collect_list(F.when(k % 7 != 0, box(F.when(k % 11 == 0, F.lit(7)).otherwise(label)))).alias("output"))
    a, b = F.col("clean"), F.col("output")
    return both.select("l_orderkey", activation.detection_count(a, b).alias("c"), activation.detection_injected(a, b, 7).alias("i")).select("l_orderkey", F.col("c.value").alias("delta"), F.col("c.decision").alias("count_decision"), F.col("i.decision").alias("injection_decision"))


def _masks(spark, d):
    cls = lambda x, at, plus: F.when(x > 0.25, plus).when(x > 0.1, 2).when(x > at, 1).otherwise(0)
    m = lambda at, plus: F.transform("embedding", lambda x: cls(x.cast("double"), at, plus))
    return table(spark, d, "embeddings").select("vec_id", m(0.0, 2).alias("clean"), m(-0.05, 3).alias("output"), m(0.02, 2).alias("truth"))


def segmentation_decisions(spark, d):
    """Vectors' components as pixels, classed by cuts as the clean mask, the condition's (with a class of its own) and the truth."""
    a, b, t = (F.col(c) for c in ("clean", "output", "truth"))
    made = {"SEGMENTATION_MASK_DISAGREEMENT": activation.mask_disagreement(a, b, 4, 0.4), "SEGMENTATION_GT_MIOU_DROP": activation.mask_truth_drop(a, b, t, 4, 0.4), "SEGMENTATION_TARGET_CLASS_EMERGENCE": activation.mask_target_emergence(a, b, 3)}
    every = F.explode(F.array(*(F.struct(F.lit(n).alias("criterion"), c.alias("x")) for n, c in made.items()))).alias("e")
    return _masks(spark, d).select("vec_id", every).select("vec_id", "e.criterion", "e.x.decision", F.round("e.x.value", 6).alias("value"))


def _decided(spark, d):
    rows = _outputs(spark, d)
    clean_class = (F.array_position("clean", F.array_max("clean")) - 1).cast("int")
    return rows.select("candidate", F.col("vec_id").alias("sample_id"), "condition", clean_class.alias("clean_class"), activation.prediction_changed(F.col("clean"), F.col("output"), TARGET).alias("decision"))


def trigger_assessment(spark, d):
    out = activation.assess(_decided(spark, d), ["candidate"])
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes))


def trigger_outcomes(spark, d):
    return activation.outcomes(_decided(spark, d), "candidate", clean_class="clean_class", target=TARGET)


def trigger_analysis(spark, d):
    out = activation.analyse(trigger_outcomes(spark, d), "candidate", permutations=500)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes))


QUERIES = {
    "trigger_decisions": trigger_decisions, "detection_decisions": detection_decisions, "segmentation_decisions": segmentation_decisions, "trigger_assessment": trigger_assessment,
    "trigger_outcomes": trigger_outcomes, "trigger_analysis": trigger_analysis,
}

_OUT = f"""o AS (SELECT vec_id, label AS candidate, condition, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS clean,
  list_transform(embedding[1:10], lambda x, i: x::DOUBLE + CASE WHEN i - 1 = CASE condition WHEN 'trigger' THEN {TARGET} WHEN 'shuffled' THEN vec_id % 10 ELSE vec_id * 7 % 10 END THEN CASE condition WHEN 'trigger' THEN CASE WHEN label % 2 = 0 THEN 0.5 ELSE 0.2 END::DOUBLE WHEN 'shuffled' THEN 0.125 ELSE 0.0625 END ELSE 0 END) AS output
  FROM embeddings, (SELECT unnest(['trigger', 'shuffled', 'noise']) AS condition)),
q AS (SELECT *, list_position(clean, list_max(clean)) - 1 AS pa, list_position(output, list_max(output)) - 1 AS pb FROM o)"""

SQL = {
    "trigger_decisions": f"""WITH {_OUT}, g AS (SELECT *, CASE WHEN vec_id % 11 = 0 THEN 'UNAVAILABLE_NON_ARRAY_OUTPUT' WHEN vec_id % 10 = 0 THEN 'NON_FINITE_VALUES' ELSE 'VALID' END AS status, clean[pa + 1] - output[pa + 1] AS dr, sqrt(list_sum(list_transform(clean, lambda x, i: (x - output[i]) * (x - output[i])))) AS l2 FROM q),
m AS (SELECT vec_id, condition, status, unnest([{{'c': 'PREDICTION_CHANGED', 'v': pb::DOUBLE, 'a': pa <> pb, 't': pb = {TARGET}}}, {{'c': 'TARGET_MATCHED', 'v': pb::DOUBLE, 'a': pb = {TARGET}, 't': pb = {TARGET}}}, {{'c': 'CONFIDENCE_DELTA_THRESHOLD', 'v': dr, 'a': dr >= 0.1, 't': pb = {TARGET}}}, {{'c': 'TENSOR_DISTANCE_THRESHOLD', 'v': l2, 'a': l2 >= 0.1, 't': NULL}}]) AS x FROM g)
SELECT vec_id, condition, x.c AS criterion, CASE WHEN status LIKE 'UNAVAILABLE%' THEN 'UNAVAILABLE' WHEN status <> 'VALID' THEN 'NOT_APPLICABLE' WHEN x.a THEN 'ACTIVATED' ELSE 'NOT_ACTIVATED' END AS decision, status, CASE WHEN status = 'VALID' THEN round(x.v, 6) END AS value, CASE WHEN status = 'VALID' THEN x.t END AS target_matched FROM m""",
    "detection_decisions": """WITH g AS (SELECT l_orderkey, count(*) FILTER (l_partkey % 7 = 0) AS gone, bool_or(l_partkey % 7 <> 0 AND l_partkey % 11 = 0) AS inj FROM lineitem GROUP BY 1)
SELECT l_orderkey, -gone::DOUBLE AS delta, CASE WHEN gone > 0 THEN 'ACTIVATED' ELSE 'NOT_ACTIVATED' END AS count_decision, CASE WHEN inj THEN 'ACTIVATED' ELSE 'NOT_ACTIVATED' END AS injection_decision FROM g""",
    "segmentation_decisions": """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.1::DOUBLE THEN 2 WHEN x > 0 THEN 1 ELSE 0 END) AS a, list_transform(embedding, lambda x: CASE WHEN x > 0.25::DOUBLE THEN 3 WHEN x > 0.1::DOUBLE THEN 2 WHEN x > -0.05::DOUBLE THEN 1 ELSE 0 END) AS b, list_transform(embedding, lambda x: CASE WHEN x > 0.1::DOUBLE THEN 2 WHEN x > 0.02::DOUBLE THEN 1 ELSE 0 END) AS t FROM embeddings),
u AS (SELECT vec_id, unnest(a) AS p, unnest(b) AS q, unnest(t) AS r FROM m), c AS (SELECT vec_id, k, count(*) FILTER (p = k AND q = k)::DOUBLE / nullif(count(*) FILTER (p = k OR q = k), 0) AS pq, count(*) FILTER (r = k AND p = k)::DOUBLE / nullif(count(*) FILTER (r = k OR p = k), 0) AS rp, count(*) FILTER (r = k AND q = k)::DOUBLE / nullif(count(*) FILTER (r = k OR q = k), 0) AS rq FROM u, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL),
j AS (SELECT vec_id, avg(pq) AS pq, avg(rp) AS rp, avg(rq) AS rq FROM c GROUP BY 1), e AS (SELECT vec_id, count(*) FILTER (q = 3) AS n FROM u GROUP BY 1),
x AS (SELECT vec_id, unnest([{'c': 'SEGMENTATION_MASK_DISAGREEMENT', 'v': 1 - pq, 'a': 1 - pq >= 0.4 - 1e-9}, {'c': 'SEGMENTATION_GT_MIOU_DROP', 'v': rp - rq, 'a': rp - rq >= 0.4 - 1e-9}, {'c': 'SEGMENTATION_TARGET_CLASS_EMERGENCE', 'v': n::DOUBLE, 'a': n > 0}]) AS z FROM j JOIN e USING (vec_id))
SELECT vec_id, z.c AS criterion, CASE WHEN z.a THEN 'ACTIVATED' ELSE 'NOT_ACTIVATED' END AS decision, round(z.v, 6) AS value FROM x""",
    "trigger_assessment": f"""WITH {_OUT}, r AS (SELECT candidate, count(*) FILTER (condition = 'trigger') AS n, {', '.join(f"round(avg((pa <> pb)::INTEGER) FILTER (condition = '{c}'), 6) AS tar{s}, round(avg((pb = {TARGET})::INTEGER) FILTER (condition = '{c}'), 6) AS tsr{s}" for c, s in zip(CONDITIONS, ('', '_shuffled', '_noise'), strict=True))} FROM q GROUP BY 1)
SELECT *, CASE WHEN n >= 10 THEN 'SUPPORT_ELIGIBLE' ELSE 'INSUFFICIENT_SUPPORT' END AS support_status FROM r""",
    "trigger_outcomes": f"""WITH {_OUT} SELECT candidate, vec_id AS sample_id, {', '.join(f"max((pb = {TARGET})::INTEGER) FILTER (condition = '{c}') AS {c}" for c in CONDITIONS)}, max((pa <> pb)::INTEGER) FILTER (condition = 'trigger') AS activated FROM q WHERE pa <> {TARGET} GROUP BY ALL""",
}
