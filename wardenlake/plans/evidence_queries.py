"""Queries of contributors and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..operators import contributors, labels

METRICS = ("label_anomaly", "label_flip", "ood", "quality", "duplicate")


def _samples(spark, d):
    """Orders as samples: their suppliers contribute; flags come from their line items."""
    i = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    raw = F.when(F.col("s_nationkey") == 3, F.lit(" none ")).otherwise(F.concat(F.lit(" n"), F.col("s_nationkey").cast("string")))
    flags = {"label_anomaly": F.max(F.col("l_returnflag") == "R"), "label_flip": F.max((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)), "ood": F.max(F.col("l_extendedprice") > 50000), "quality": F.max(F.col("l_discount") >= 0.1), "duplicate": F.count("*") > F.countDistinct("l_linenumber")}
    s = i.groupBy("l_orderkey").agg(F.collect_set(raw).alias("contributors"), *(e.alias(n) for n, e in flags.items()))
    return s.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("label")), "l_orderkey")


def _attributed(spark, d):
    return contributors.attribute(_samples(spark, d), "contributors")


def _events(spark, d):
    """Events as samples of one contributor, their user; errors are anomalies."""
    e = table(spark, d, "events").select("event_id", F.array(F.col("user_id").cast("string")).alias("contributors"), (F.col("event_type") == "error").alias("label_anomaly"), F.date_format("ts", "E").alias("label"))
    return contributors.attribute(e, "contributors")


def _round(df, *names, places=6):
    return df.select(*(F.round(c, places).alias(c) if c in names else c for c in df.columns))


def fractional_attribution(spark, d):
    return _round(contributors.exposures(_attributed(spark, d)), "exposure")


def loo_baseline(spark, d):
    out = contributors.rates(_attributed(spark, d), METRICS)
    return _round(out.select("contributor", "metric", "exposure", "count", "rate", "wilson_low", "wilson_high", "bg_rate", "differential", "standard_error", "share", "baseline_status"), "exposure", "count", "rate", "wilson_low", "wilson_high", "bg_rate", "differential", "standard_error", "share")


def stratified_loo(spark, d):
    out = contributors.rates(_events(spark, d), ["label_anomaly"], by=["label"])
    return _round(out.select("label", "contributor", "exposure", "rate", "bg_rate", "differential", "baseline_status"), "exposure", "rate", "bg_rate", "differential")


def class_entropy(spark, d):
    out = contributors.class_entropy(_events(spark, d), "label")
    return _round(out.select("contributor", "entropy", "top_share"), "entropy", "top_share")


def anomaly_hhi(spark, d):
    return _round(contributors.concentration(contributors.rates(_attributed(spark, d), METRICS)), "hhi")


def gini(spark, d):
    return _round(contributors.gini(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"), "gini")


def eb_shrinkage(spark, d):
    out = contributors.shrink(contributors.rates(_events(spark, d), ["label_anomaly"]))
    return _round(out.select("contributor", "shrunk_rate", "shrinkage", "eb_differential", "eb_standard_error", "confidence", "support_state"), "shrunk_rate", "shrinkage", "eb_differential", "eb_standard_error", "confidence")


def contributor_findings(spark, d):
    return _round(contributors.findings(_attributed(spark, d), "label", METRICS), "confidence")


def contributor_risk(spark, d):
    out = contributors.risk(_attributed(spark, d), {"labels": ["label_anomaly", "label_flip"], "content": ["ood", "quality"], "copies": ["duplicate"]})
    return _round(out, "differential", "confidence")


K = 10


def _folds(spark, d):
    return labels.stratified_folds(table(spark, d, "embeddings"), "label", "vec_id")


def _predictions(spark, d):
    """Out-of-fold probabilities; every seventh label is moved on by one."""
    p = labels.out_of_fold_centroids(_folds(spark, d), "embedding", "label")
    # probabilities on a grid, so that ties and thresholds don't hang on the last bit
    p = p.withColumn("probs", F.transform("probs", lambda x: F.round(x, 9)))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % K).otherwise(F.col("label"))
    return p.select(F.col("vec_id").alias("sample_id"), moved.cast("int").alias("observed"), "probs")


def stratified_folds(spark, d):
    return _folds(spark, d).select("vec_id", "label", "fold")


def centroid_oof_probs(spark, d):
    p = _predictions(spark, d)
    return p.select("sample_id", F.posexplode("probs").alias("class", "p")).select("sample_id", "class", "p")


def class_thresholds(spark, d):
    return _round(labels.thresholds(_predictions(spark, d), K), "t")


def confident_counts(spark, d):
    return labels.confident_counts(_predictions(spark, d), K)


def joint_noise(spark, d):
    return _round(labels.joint_noise(_predictions(spark, d), K), "q")


def label_anomalies(spark, d):
    out = labels.anomalies(_predictions(spark, d), K)
    return _round(out.select("sample_id", "observed", "latent", "margin", "score", "confidence", "category").withColumn("confidence", F.round("confidence", 9)), "margin", "score")


def transition_rates(spark, d):
    return _round(labels.transition_rates(_predictions(spark, d), K), "rate")


def flip_scores(spark, d):
    out = labels.flips(_predictions(spark, d), K)
    return _round(out.select("observed", "latent", "n", "n_back", "rate", "asymmetry", "nci", "score", "category", "confidence"), "rate", "asymmetry", "nci", "score", "confidence")


def flip_collapses(spark, d):
    """Labels of three classes moved to class 9 in two cases of three: a sink."""
    p = _predictions(spark, d)
    p = p.withColumn("observed", F.when(argmax_in(p, (1, 2, 3)) & (F.col("sample_id") % 3 > 0), labels.argmax(F.col("probs"))).otherwise(F.col("observed")))
    p = p.withColumn("probs", F.when(F.col("observed").isin(1, 2, 3) & (F.col("sample_id") % 3 > 0), F.array(*(F.lit(1.0 if i == 9 else 0.0) for i in range(K)))).otherwise(F.col("probs")))
    return labels.collapses(labels.flips(p, K))


def argmax_in(p, classes):
    return labels.argmax(F.col("probs")).isin(*classes)


def contributor_flips(spark, d):
    p = _predictions(spark, d).withColumn("contributor", F.when(F.col("sample_id") % 7 == 0, F.lit("mover")).otherwise(F.concat(F.lit("c"), (F.col("sample_id") % 3).cast("string"))))
    out = labels.contributor_flips(p, "contributor")
    return _round(out.select("contributor", "observed", "latent", "own", "own_total", "rate", "baseline", "differential"), "rate", "baseline", "differential")


QUERIES = {
    "fractional_attribution": fractional_attribution, "loo_baseline": loo_baseline, "stratified_loo": stratified_loo, "class_entropy": class_entropy, "anomaly_hhi": anomaly_hhi, "gini": gini,
    "eb_shrinkage": eb_shrinkage, "contributor_findings": contributor_findings, "contributor_risk": contributor_risk, "stratified_folds": stratified_folds, "centroid_oof_probs": centroid_oof_probs,
    "class_thresholds": class_thresholds, "confident_counts": confident_counts, "joint_noise": joint_noise, "label_anomalies": label_anomalies, "transition_rates": transition_rates,
    "flip_scores": flip_scores, "flip_collapses": flip_collapses, "contributor_flips": contributor_flips,
}

_SAMPLES = """i AS (SELECT l.*, CASE WHEN s_nationkey = 3 THEN NULL ELSE 'n' || s_nationkey END AS c FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey),
sm AS (SELECT l_orderkey AS id, coalesce(nullif(list_sort(list_distinct(list(c) FILTER (c IS NOT NULL))), []), ['UNATTRIBUTED']) AS cs, bool_or(l_returnflag = 'R') AS label_anomaly, bool_or(l_returnflag = 'R' AND l_quantity > 40) AS label_flip,
  bool_or(l_extendedprice > 50000) AS ood, bool_or(l_discount >= 0.1) AS quality, count(*) > count(DISTINCT l_linenumber) AS duplicate FROM i GROUP BY 1),
a AS (SELECT sm.*, o_orderpriority AS label, 1.0::DOUBLE / len(cs) AS w, unnest(cs) AS contributor FROM sm JOIN orders ON o_orderkey = id)"""
_EVENTS = "a AS (SELECT event_id AS id, user_id::VARCHAR AS contributor, 1.0::DOUBLE AS w, event_type = 'error' AS label_anomaly, strftime(ts, '%a') AS label FROM events)"


def _rates(metrics, by: str = "") -> str:
    b = f"{by}, " if by else ""
    long = " UNION ALL ".join(f"SELECT {b}contributor, '{m}' AS metric, sum(w) AS exposure, coalesce(sum(w) FILTER ({m}), 0) AS cnt FROM a GROUP BY {b}contributor" for m in metrics)
    over = f"OVER (PARTITION BY {b}metric)"
    return f"""lg AS ({long}), tt AS (SELECT *, sum(exposure) {over} AS ae, sum(cnt) {over} AS ac FROM lg),
r0 AS (SELECT *, least(cnt, exposure) / exposure AS rate, greatest(0, ae - exposure) AS be, greatest(0, ac - cnt) AS bc FROM tt),
r1 AS (SELECT *, CASE WHEN be > 1e-9 THEN least(1.0, bc / be) END AS bg_rate, 1 + 3.841458820694124 / exposure AS dn, rate + 3.841458820694124 / (2 * exposure) AS ce,
  1.959963984540054 * sqrt(rate * (1 - rate) / exposure + 3.841458820694124 / (4 * exposure * exposure)) AS mg FROM r0),
rt AS (SELECT *, greatest(0.0, least(1.0, (ce - mg) / dn)) AS wl, greatest(0.0, least(1.0, (ce + mg) / dn)) AS wh, rate - bg_rate AS diff,
  sqrt(rate * (1 - rate) / greatest(1e-4, exposure) + bg_rate * (1 - bg_rate) / greatest(1e-4, be)) AS se, CASE WHEN ac > 0 THEN cnt / ac ELSE 0 END AS share, CASE WHEN bg_rate IS NULL THEN 'INSUFFICIENT_BACKGROUND_SUPPORT' ELSE 'VALID' END AS bs FROM r1)"""


_HHI = "hh AS (SELECT metric, least(1.0, sum((share / t) * (share / t))) AS hhi FROM (SELECT metric, share, sum(share) OVER (PARTITION BY metric) AS t FROM rt WHERE share > 0) GROUP BY metric)"
_EB = """eb AS (SELECT *, coalesce(bg_rate, 0) AS mu, CASE WHEN exposure < 3 THEN 'UNVERIFIABLE' WHEN exposure < 10 THEN 'LOW_SUPPORT' WHEN exposure < 30 THEN 'MODERATE_SUPPORT' ELSE 'ADEQUATE_SUPPORT' END AS st, exposure / (exposure + 20) AS lam FROM rt),
e2 AS (SELECT *, CASE WHEN exposure < 3 THEN mu ELSE lam * rate + (1 - lam) * mu END AS sr, CASE WHEN exposure < 3 THEN 0.0 WHEN exposure < 10 THEN least(0.5, exposure / 10 * 0.5) WHEN exposure < 30 THEN least(0.85, 0.5 + 0.35 * (exposure - 10) / 20) ELSE least(0.99, 0.85 + 0.14 * (1 - exp(-0.05 * (exposure - 30)))) END AS conf FROM eb)"""
_FOLDS = "f AS (SELECT vec_id, embedding, label, ((row_number() OVER (PARTITION BY label ORDER BY sha256(vec_id::VARCHAR || ':42'), vec_id) - 1) % 5)::INTEGER AS fold FROM embeddings)"
_OOF = f"""{_FOLDS}, un AS (SELECT vec_id, label, fold, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nr FROM f),
ux AS (SELECT vec_id, label, fold, unnest(range(1, len(e) + 1)) AS i, unnest(e) / nr AS x FROM un),
cs AS (SELECT k.fold, u.label, u.i, sum(u.x) AS d FROM ux u, (SELECT DISTINCT fold FROM f) k WHERE u.fold <> k.fold GROUP BY ALL),
cn AS (SELECT fold, label, i, d / sqrt(sum(d * d) OVER (PARTITION BY fold, label)) AS d FROM cs),
co AS (SELECT u.vec_id, c.label AS cls, exp(10.0 * sum(u.x * c.d)) AS ex FROM ux u JOIN cn c ON c.fold = u.fold AND c.i = u.i GROUP BY ALL),
cp AS (SELECT vec_id, cls, round(ex / sum(ex) OVER (PARTITION BY vec_id), 9) AS p FROM co),
pr AS (SELECT vec_id AS sample_id, (CASE WHEN vec_id % 7 = 0 THEN (max(label) + 1) % 10 ELSE max(label) END)::INTEGER AS observed, list(p ORDER BY cls) AS probs FROM cp JOIN f USING (vec_id) GROUP BY vec_id)"""
_TH = "th AS (SELECT c.label, least(1.0, coalesce(avg(probs[observed + 1]), 0.1)) AS t, count(observed) AS n FROM (SELECT unnest(range(0, 10))::INTEGER AS label) c LEFT JOIN pr ON observed = c.label GROUP BY 1)"
_TA = "ta AS (SELECT list(t ORDER BY label) AS ts, list(n ORDER BY label) AS ns FROM th)"
_CC = f"""{_TH}, {_TA}, ad AS (SELECT *, list_transform(range(1, 11), lambda k: probs[k] - ts[k]) AS z FROM pr, ta), ab AS (SELECT *, list_position(z, list_max(z)) - 1 AS best FROM ad),
cc AS (SELECT observed, (CASE WHEN probs[best + 1] >= ts[best + 1] THEN best ELSE observed END)::INTEGER AS latent, count(*) AS n FROM ab GROUP BY ALL)"""
_TR = "tr AS (SELECT observed, (list_position(probs, list_max(probs)) - 1)::INTEGER AS latent, count(*) AS n, avg(list_max(probs) - probs[observed + 1]) AS margin FROM pr GROUP BY ALL)"
_FL = f"""{_TR}, rw AS (SELECT observed, sum(n) AS ns, sum(n) FILTER (observed = latent) AS same FROM tr GROUP BY 1),
f1 AS (SELECT t.observed, t.latent, t.n, t.margin, ns, coalesce(b.n, 0) AS nb, t.n::DOUBLE / ns AS rate, (t.n - coalesce(b.n, 0))::DOUBLE / (t.n + coalesce(b.n, 0)) AS asym, t.n::DOUBLE / (ns - coalesce(same, 0)) AS nci,
  CASE WHEN t.n < 3 THEN 0.0 ELSE 1 / (1 + exp(-0.5 * (t.n - 6.0))) END AS disc FROM tr t JOIN rw USING (observed) LEFT JOIN tr b ON b.observed = t.latent AND b.latent = t.observed WHERE t.observed <> t.latent),
f2 AS (SELECT *, disc * rate * greatest(0.0, asym) * nci AS tfs, greatest(0.0, (rate + 3.8416 / (2 * ns) - 1.96 * sqrt(rate * (1 - rate) / ns + 3.8416 / (4.0 * ns * ns))) / (1 + 3.8416 / ns)) AS wl FROM f1),
f3 AS (SELECT *, CASE WHEN ns < 5 OR n < 3 THEN 'INSUFFICIENT_SUPPORT' WHEN abs(asym) <= 0.35 AND nb >= 3 THEN 'RECIPROCAL_CLASS_CONFUSION' WHEN tfs >= 0.4 AND asym >= 0.5 AND nci >= 0.5 THEN 'POSSIBLE_LABEL_FLIP'
  WHEN asym >= 0.4 THEN 'DIRECTIONAL_LABEL_TRANSITION' WHEN rate >= 0.2 THEN 'SYSTEMATIC_CLASS_TRANSITION' ELSE 'DIRECTIONAL_LABEL_TRANSITION' END AS category FROM f2)"""
_ENTROPY = "c AS (SELECT contributor, label, sum(w) AS w FROM a GROUP BY ALL), p AS (SELECT contributor, w / sum(w) OVER (PARTITION BY contributor) AS p FROM c), en AS (SELECT contributor, greatest(0.0, -sum(p * log2(p))) AS entropy, max(round(p, 9)) AS top_share FROM p GROUP BY 1)"

SQL = {
    "fractional_attribution": f"WITH {_SAMPLES} SELECT contributor, round(sum(w), 6) AS exposure, count(*) AS n_samples, count(*) FILTER (len(cs) > 1) AS n_shared FROM a GROUP BY 1",
    "loo_baseline": f"WITH {_SAMPLES}, {_rates(METRICS)} SELECT contributor, metric, round(exposure, 6) AS exposure, round(cnt, 6) AS count, round(rate, 6) AS rate, round(wl, 6) AS wilson_low, round(wh, 6) AS wilson_high, round(bg_rate, 6) AS bg_rate, round(diff, 6) AS differential, round(se, 6) AS standard_error, round(share, 6) AS share, bs AS baseline_status FROM rt",
    "stratified_loo": f"WITH {_EVENTS}, {_rates(['label_anomaly'], 'label')} SELECT label, contributor, round(exposure, 6) AS exposure, round(rate, 6) AS rate, round(bg_rate, 6) AS bg_rate, round(diff, 6) AS differential, bs AS baseline_status FROM rt",
    "class_entropy": f"WITH {_EVENTS}, {_ENTROPY} SELECT contributor, round(entropy, 6) AS entropy, round(top_share, 6) AS top_share FROM en",
    "anomaly_hhi": f"WITH {_SAMPLES}, {_rates(METRICS)}, {_HHI} SELECT metric, round(hhi, 6) AS hhi FROM hh",
    "gini": """WITH r AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS i FROM orders)
SELECT o_orderpriority, round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1.0::DOUBLE) / count(*), 6) AS gini FROM r GROUP BY 1""",
    "eb_shrinkage": f"""WITH {_EVENTS}, {_rates(['label_anomaly'])}, {_EB} SELECT contributor, round(sr, 6) AS shrunk_rate, round(CASE WHEN exposure < 3 THEN 0 ELSE lam END, 6) AS shrinkage, round(CASE WHEN exposure < 3 THEN 0 ELSE sr - mu END, 6) AS eb_differential,
  round(CASE WHEN exposure < 3 THEN 0 ELSE sqrt(sr * (1 - sr) / greatest(1.0, exposure + 20) + mu * (1 - mu) / greatest(1.0, be)) END, 6) AS eb_standard_error, round(conf, 6) AS confidence, st AS support_state FROM e2""",
    "contributor_findings": f"""WITH {_SAMPLES}, {_rates(METRICS)}, {_HHI}, {_ENTROPY}, ex AS (SELECT contributor, sum(w) AS exposure FROM a GROUP BY 1), m AS (SELECT rt.*, hhi FROM rt LEFT JOIN hh USING (metric)),
o AS (SELECT contributor, 'INSUFFICIENT_CONTRIBUTOR_SUPPORT' AS category, 'LOW' AS severity, 0.0 AS confidence FROM ex WHERE exposure < 5 AND contributor <> 'UNATTRIBUTED'
UNION ALL SELECT DISTINCT contributor, 'UNATTRIBUTED_EVIDENCE', 'LOW', 1.0 FROM m WHERE contributor = 'UNATTRIBUTED' AND cnt > 0
UNION ALL SELECT contributor, 'CONTRIBUTOR_CLASS_DISTRIBUTION', 'LOW', top_share FROM en JOIN ex USING (contributor) WHERE exposure >= 5 AND contributor <> 'UNATTRIBUTED' AND entropy < 0.5 AND top_share >= 0.85
UNION ALL SELECT contributor, 'CONTRIBUTOR_MULTI_SIGNAL_EVIDENCE', 'HIGH', least(1.0, 0.5 + 0.15 * count(*)) FROM m WHERE exposure >= 5 AND contributor <> 'UNATTRIBUTED' AND (wl >= 0.05 OR (rate > 0.15 AND cnt >= 2)) GROUP BY 1 HAVING count(*) >= 3
UNION ALL SELECT contributor, 'CONTRIBUTOR_ANOMALY_CONCENTRATION', 'MEDIUM', share FROM m WHERE exposure >= 5 AND contributor <> 'UNATTRIBUTED' AND cnt > 0 AND share >= 0.5 AND hhi >= 0.4
UNION ALL SELECT contributor, 'CONTRIBUTOR_LABEL_TRANSITION', 'MEDIUM', least(1.0, greatest(0.5, wl)) FROM m WHERE exposure >= 5 AND contributor <> 'UNATTRIBUTED' AND cnt > 0 AND metric = 'label_flip' AND diff >= 0.3
UNION ALL SELECT contributor, CASE metric WHEN 'ood' THEN 'CONTRIBUTOR_OOD_CONCENTRATION' WHEN 'quality' THEN 'CONTRIBUTOR_QUALITY_CONCENTRATION' ELSE 'CONTRIBUTOR_DUPLICATE_CONCENTRATION' END, 'MEDIUM', least(1.0, wl * 1.5) FROM m
  WHERE exposure >= 5 AND contributor <> 'UNATTRIBUTED' AND cnt > 0 AND ((metric IN ('ood', 'duplicate') AND diff >= 0.25 AND wl >= 0.15) OR (metric = 'quality' AND diff >= 0.3 AND wl >= 0.2)))
SELECT contributor, category, severity, round(confidence::DOUBLE, 6) AS confidence FROM o""",
    "contributor_risk": f"""WITH {_SAMPLES}, {_rates(METRICS)}, {_EB}, b AS (SELECT contributor, round(CASE WHEN exposure < 3 THEN 0 ELSE sr - mu END, 9) AS d, CASE WHEN metric IN ('label_anomaly', 'label_flip') THEN 'labels' WHEN metric IN ('ood', 'quality') THEN 'content' ELSE 'copies' END AS family, conf, st FROM e2)
SELECT contributor, family, round(d, 6) AS differential, round(conf, 6) AS confidence, CASE WHEN st = 'UNVERIFIABLE' THEN 'UNVERIFIABLE' WHEN d >= 0.25 THEN 'HIGH_DIFFERENTIAL' WHEN d >= 0.1 THEN 'ELEVATED' ELSE 'WITHIN_BASELINE' END AS status
FROM b QUALIFY row_number() OVER (PARTITION BY contributor ORDER BY d DESC, family DESC, conf DESC, st DESC) = 1""",
    "stratified_folds": f"WITH {_FOLDS} SELECT vec_id, label, fold FROM f",
    "centroid_oof_probs": f"WITH {_OOF} SELECT vec_id AS sample_id, cls AS class, p FROM cp",
    "class_thresholds": f"WITH {_OOF}, {_TH} SELECT label, round(t, 6) AS t, n FROM th",
    "confident_counts": f"WITH {_OOF}, {_CC} SELECT observed, latent, n FROM cc",
    "joint_noise": f"""WITH {_OOF}, {_CC}, q AS (SELECT c.observed, c.latent, c.n::DOUBLE / sum(c.n) OVER (PARTITION BY c.latent) * coalesce(th.n, 0) / (SELECT count(*) FROM pr) AS q FROM cc c JOIN th ON th.label = c.latent)
SELECT observed, latent, round(q / sum(q) OVER (), 6) AS q FROM q""",
    "label_anomalies": f"""WITH {_OOF}, {_TH}, {_TA}, m0 AS (SELECT *, list_transform(range(0, 10), lambda k: CASE WHEN k = observed THEN -1.0 ELSE probs[k + 1] END) AS mk FROM pr, ta), m1 AS (SELECT *, (list_position(mk, list_max(mk)) - 1)::INTEGER AS latent FROM m0),
m2 AS (SELECT *, probs[observed + 1] AS op, probs[latent + 1] AS lp, ns[observed + 1] AS nc, (probs[latent + 1] - ts[latent + 1]) - (probs[observed + 1] - ts[observed + 1]) AS margin FROM m1),
sy AS (SELECT observed, latent FROM m2 WHERE margin > 0 GROUP BY ALL HAVING count(*)::DOUBLE / max(nc) >= 0.15),
m3 AS (SELECT m2.*, least(1.0, nc / 20.0) * lp AS raw, CASE WHEN nc <= 1 THEN 'INSUFFICIENT_EVIDENCE' WHEN margin <= 0 THEN 'MODEL_DISAGREEMENT' WHEN nc < 5 THEN 'RARE_CLASS_ANOMALY' WHEN lp >= 0.8 AND op <= 0.2 THEN 'HIGH_CONFIDENCE_ALTERNATIVE_CLASS'
  WHEN sy.observed IS NOT NULL THEN 'CLASS_SYSTEMATIC_ANOMALY' ELSE 'POSSIBLE_LABEL_MISMATCH' END AS category FROM m2 LEFT JOIN sy ON sy.observed = m2.observed AND sy.latent = m2.latent)
SELECT sample_id, observed, latent, round(margin, 6) AS margin, round(1 / (1 + exp(-5 * margin)), 6) AS score, round(CASE WHEN nc <= 1 OR (margin <= 0 AND lp <= op) THEN 0 WHEN category = 'RARE_CLASS_ANOMALY' THEN raw * 0.5 ELSE raw END, 9) AS confidence, category FROM m3""",
    "transition_rates": f"""WITH {_OOF}, {_TR}, ce AS (SELECT a.k::INTEGER AS observed, b.k::INTEGER AS latent FROM (SELECT unnest(range(0, 10)) AS k) a, (SELECT unnest(range(0, 10)) AS k) b), w AS (SELECT ce.*, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY ce.observed) AS rs FROM ce LEFT JOIN tr USING (observed, latent))
SELECT observed, latent, n, round(CASE WHEN rs > 0 THEN n::DOUBLE / rs ELSE (observed = latent)::INTEGER END, 6) AS rate FROM w""",
    "flip_scores": f"""WITH {_OOF}, {_FL} SELECT observed, latent, n, nb AS n_back, round(rate, 6) AS rate, round(asym, 6) AS asymmetry, round(nci, 6) AS nci, round(tfs, 6) AS score, category,
  round(CASE category WHEN 'INSUFFICIENT_SUPPORT' THEN 0 WHEN 'RECIPROCAL_CLASS_CONFUSION' THEN wl * 0.5 WHEN 'POSSIBLE_LABEL_FLIP' THEN CASE WHEN margin < 0.2 THEN wl * 0.5 ELSE wl END ELSE wl * disc END, 6) AS confidence FROM f3""",
    "flip_collapses": f"""WITH {_OOF.replace('pr AS (', 'pr0 AS (')}, p1 AS (SELECT sample_id, CASE WHEN (list_position(probs, list_max(probs)) - 1) IN (1, 2, 3) AND sample_id % 3 > 0 THEN (list_position(probs, list_max(probs)) - 1)::INTEGER ELSE observed END AS observed, probs FROM pr0),
pr AS (SELECT sample_id, observed, CASE WHEN observed IN (1, 2, 3) AND sample_id % 3 > 0 THEN [0, 0, 0, 0, 0, 0, 0, 0, 0, 1]::DOUBLE[] ELSE probs END AS probs FROM p1), {_FL}
SELECT latent AS sink, count(DISTINCT observed) AS n_sources, 0.8::DOUBLE AS score, 0.85::DOUBLE AS confidence FROM f3 WHERE category = 'POSSIBLE_LABEL_FLIP' GROUP BY 1 HAVING count(DISTINCT observed) >= 3""",
    "contributor_flips": f"""WITH {_OOF}, p AS (SELECT CASE WHEN sample_id % 7 = 0 THEN 'mover' ELSE 'c' || (sample_id % 3) END AS contributor, observed, (list_position(probs, list_max(probs)) - 1)::INTEGER AS latent FROM pr),
ot AS (SELECT contributor, observed, count(*) AS own_total FROM p GROUP BY ALL), ow AS (SELECT contributor, observed, latent, count(*) AS own FROM p WHERE observed <> latent GROUP BY ALL),
j AS (SELECT ow.*, own_total, sum(own) OVER (PARTITION BY ow.observed, latent) AS pair, (SELECT sum(own_total) FROM ot t WHERE t.observed = ow.observed) AS total FROM ow JOIN ot ON ot.contributor = ow.contributor AND ot.observed = ow.observed),
r AS (SELECT *, own::DOUBLE / own_total AS rate, (pair - own)::DOUBLE / greatest(1, total - own_total) AS base FROM j)
SELECT contributor, observed, latent, own, own_total, round(rate, 6) AS rate, round(base, 6) AS baseline, round(rate - base, 6) AS differential FROM r WHERE own_total >= 5 AND own >= 3 AND rate - base >= 0.25""",
}
