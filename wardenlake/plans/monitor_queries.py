"""Queries over time, by source, and against baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..operators import profiles, source, temporal
from .drift_queries import _KS, _PSI, _W1

DAY = 86400


def _windows(spark, d, step=None):
    return temporal.assign_windows(table(spark, d, "events"), "ts", 5 * DAY, step)


def fixed_windows(spark, d):
    return temporal.describe_windows(_windows(spark, d)).withColumn("window_index", F.col("window_index").cast("long"))


def sliding_windows(spark, d):
    return temporal.describe_windows(_windows(spark, d, 3 * DAY)).withColumn("window_index", F.col("window_index").cast("long"))


def _shown(c):
    return c.select(F.col("target").cast("long").alias("target"), "n_ref", "n_target", F.round("ks", 6).alias("ks"), F.round("adjusted_p", 6).alias("adjusted_p"), F.round("psi", 6).alias("psi"), "status")


def baseline_vs_windows(spark, d):
    return _shown(temporal.comparisons(_windows(spark, d), "value"))


def adjacent_windows(spark, d):
    return _shown(temporal.comparisons(_windows(spark, d), "value", "adjacent"))


def _drifting(spark, d):
    """The events with values that rise from the fourth window on."""
    w = _windows(spark, d)
    return w.withColumn("value", F.col("value") + F.when(F.col("window_index") >= 3, 60.0 * F.col("window_index")).otherwise(0.0))


def change_points(spark, d):
    c = temporal.change_points(temporal.comparisons(_drifting(spark, d), "value", "adjacent"))
    return c.select(F.col("target").cast("long").alias("target"), F.round("discrepancy", 6).alias("discrepancy"), F.round("adjusted_p", 6).alias("adjusted_p"), "confidence")


def trajectory(spark, d):
    w = _drifting(spark, d)
    return temporal.trajectory(temporal.comparisons(w, "value"), temporal.comparisons(w, "value", "adjacent"))


def normalized_times(spark, d):
    """Times as ISO text, epoch seconds or a day-first form, by the order's number."""
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 3 == 1, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss"))
    return o.select("o_orderkey", text.alias("raw")).select("o_orderkey", temporal.normalize_time("raw").alias("time"))


def _named(spark, d):
    docs = table(spark, d, "documents").withColumn("raw", F.concat(F.lit("  "), F.upper("source"), F.lit("\t"), F.lit(" Vendor Ａ ")))
    return source.canonicalize(docs, "raw")


def source_canonicalize(spark, d):
    c = _named(spark, d).groupBy("canonical_source").agg(F.count("*").alias("n"))
    return c.withColumn("pseudonym", source.pseudonym("project", F.col("canonical_source"), "salt"))


def source_eligibility(spark, d):
    return source.groups(table(spark, d, "events"), "user_id", 65)


def source_fragmentation(spark, d):
    out = source.fragmentation(table(spark, d, "events"), "user_id", 65)
    return out.withColumn("small_share", F.round("small_share", 6))


def source_vs_reference(spark, d):
    out = source.against_reference(table(spark, d, "documents"), "n_chars", "lang", "source")
    return out.select("target", "n_ref", "n_target", *(F.round(c, 6).alias(c) for c in ("ks", "adjusted_p", "psi", "label_tvd")), "status", "confounded", F.col("place").cast("int").alias("place"))


def five_number_profile(spark, d):
    out = profiles.five_number(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "p25", "median", "p75", "p95")))


def median_mad(spark, d):
    out = profiles.median_mad(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", "n", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


def _metrics(spark, d):
    """Baseline: values of the first fifteen days by type; observed: all later ones."""
    e = table(spark, d, "events").select(F.col("event_type").alias("metric"), "value", "event_id", F.to_date("ts").alias("day"))
    return e.where("day < date '2024-01-16'"), e.where("day >= date '2024-01-16'")


def robust_z_anomalies(spark, d):
    base, seen = _metrics(spark, d)
    side = F.when(F.col("metric") == "error", profiles.HIGHER).when(F.col("metric") == "view", profiles.LOWER).otherwise(profiles.TWO_SIDED)
    out = profiles.evaluate_metrics(seen, base, side)
    return out.select("event_id", "metric", F.round("robust_z", 6).alias("robust_z"), F.round("tail", 6).alias("tail"), "status", "support")


def empirical_percentiles(spark, d):
    base, seen = _metrics(spark, d)
    return profiles.percentile_rank(seen, base).select("event_id", F.round("percentile", 6).alias("percentile"))


def family_rollup(spark, d):
    base, seen = _metrics(spark, d)
    out = profiles.evaluate_metrics(seen, base).withColumn("family", F.when(F.col("metric").isin("click", "view"), "engagement").otherwise("outcome"))
    return profiles.family_rollup(out.withColumn("bucket", F.col("event_id") % 10), ["bucket"])


QUERIES = {
    "fixed_windows": fixed_windows, "sliding_windows": sliding_windows, "baseline_vs_windows": baseline_vs_windows, "adjacent_windows": adjacent_windows, "change_points": change_points,
    "trajectory": trajectory, "normalized_times": normalized_times, "source_canonicalize": source_canonicalize, "source_eligibility": source_eligibility, "source_fragmentation": source_fragmentation,
    "source_vs_reference": source_vs_reference, "five_number_profile": five_number_profile, "median_mad": median_mad, "robust_z_anomalies": robust_z_anomalies,
    "empirical_percentiles": empirical_percentiles, "family_rollup": family_rollup,
}

_WIN = "w0 AS (SELECT min(ts) AS t0 FROM events), win AS (SELECT e.*, floor((epoch_us(ts) - epoch_us(t0)) / 1e6 / 432000)::BIGINT AS i FROM events e, w0)"
_DRIFTING = "win2 AS (SELECT i, value + CASE WHEN i >= 3 THEN 60.0 * i ELSE 0.0 END AS value FROM win)"
_FAM = """sd AS (SELECT feature, stddev_pop(value) AS sd FROM l WHERE NOT tgt GROUP BY feature),
j AS (SELECT ks.*, psi, CASE WHEN sd > 1e-12 THEN w1 / sd ELSE w1 END AS w1s, row_number() OVER (ORDER BY p, ks.feature) AS rank, count(*) OVER () AS k FROM ks JOIN psi USING (feature) JOIN w1 USING (feature) JOIN sd USING (feature)),
q AS (SELECT *, least(1.0, min(p * (k::DOUBLE / rank)) OVER (ORDER BY rank DESC)) AS adj FROM j),
g AS (SELECT *, CASE WHEN adj <= 0.05 AND (psi >= 0.10 OR w1s >= 0.10) THEN 'MATERIAL_SHIFT' WHEN adj <= 0.05 THEN 'SIGNIFICANT_SHIFT' ELSE 'NO_SHIFT_DETECTED' END AS status FROM q)"""


def _comparison(rows: str, kind: str, more: str = "") -> str:
    ok = f"ok AS (SELECT i FROM {rows} GROUP BY i HAVING count(*) >= 30)"
    if kind == "adjacent":
        long = f"""l AS (SELECT TRUE AS tgt, i AS feature, value FROM {rows} WHERE i IN (SELECT i FROM ok) AND i - 1 IN (SELECT i FROM ok)
          UNION ALL SELECT FALSE, i + 1, value FROM {rows} WHERE i IN (SELECT i FROM ok) AND i + 1 IN (SELECT i FROM ok))"""
    else:
        long = f"""l AS (SELECT TRUE AS tgt, i AS feature, value FROM {rows} WHERE i > 0 AND i IN (SELECT i FROM ok)
          UNION ALL SELECT FALSE, ok.i, value FROM {rows} r, ok WHERE r.i = 0 AND ok.i > 0)"""
    return f"WITH {_WIN}, {more}{ok}, {long}, {_KS}, {_PSI}, {_W1}, {_FAM}"


_SHOW = "SELECT feature AS target, nr AS n_ref, nt AS n_target, round(ks, 6) AS ks, round(adj, 6) AS adjusted_p, round(psi, 6) AS psi, status FROM g"
_BASE = """b AS (SELECT event_type AS metric, value FROM events WHERE ts < TIMESTAMP '2024-01-16'), s AS (SELECT event_type AS metric, value, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
m AS (SELECT metric, count(*) AS n, median(value) AS med FROM b GROUP BY metric), a AS (SELECT m.*, (SELECT median(abs(value - med)) FROM b WHERE b.metric = m.metric) AS mad FROM m),
e AS (SELECT s.metric, s.value, s.event_id, max(n) AS n, max(med) AS med, max(mad) AS mad, count(*) FILTER (b.value <= s.value) AS le, count(*) FILTER (b.value >= s.value) AS ge, count(*) FILTER (b.value = s.value) AS eq
  FROM s JOIN a ON a.metric = s.metric JOIN b ON b.metric = s.metric GROUP BY ALL)"""


def _evaluated(side: str) -> str:
    return f"""{_BASE}, t AS (SELECT *, {side} AS side, (value - med) / (1.4826 * mad) AS z FROM e),
u AS (SELECT *, CASE side WHEN 'L' THEN le::DOUBLE / n WHEN 'H' THEN ge::DOUBLE / n ELSE least(1.0, 2.0 * least(le::DOUBLE / n, ge::DOUBLE / n)) END AS tail FROM t),
v AS (SELECT *, CASE WHEN (CASE side WHEN 'H' THEN z >= 3.5 WHEN 'L' THEN z <= -3.5 ELSE abs(z) >= 3.5 END) OR tail <= 0.01 THEN 'ANOMALOUS' ELSE 'NORMAL' END AS status FROM u)"""


_SIDE = "CASE metric WHEN 'error' THEN 'H' WHEN 'view' THEN 'L' ELSE 'T' END"

SQL = {
    "fixed_windows": f"WITH {_WIN} SELECT i AS window_index, max(t0) + to_seconds(i * 432000) AS window_start, count(*) AS n, count(*) >= 30 AS valid FROM win, w0 GROUP BY i",
    "sliding_windows": """WITH w0 AS (SELECT min(ts) AS t0 FROM events), a AS (SELECT (epoch_us(ts) - epoch_us(t0)) / 1e6 AS s FROM events, w0),
x AS (SELECT unnest(range(greatest(0, floor((s - 432000) / 259200)::BIGINT + 1), floor(s / 259200)::BIGINT + 1)) AS i FROM a)
SELECT i AS window_index, max(t0) + to_seconds(i * 259200) AS window_start, count(*) AS n, count(*) >= 30 AS valid FROM x, w0 GROUP BY i""",
    "baseline_vs_windows": f"{_comparison('win', 'baseline')} {_SHOW}",
    "adjacent_windows": f"{_comparison('win', 'adjacent')} {_SHOW}",
    "change_points": f"{_comparison('win2', 'adjacent', _DRIFTING + ', ')} SELECT feature AS target, round(psi, 6) AS discrepancy, round(adj, 6) AS adjusted_p, CASE WHEN adj <= 0.01 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM g WHERE status = 'MATERIAL_SHIFT'",
    "trajectory": f"""{_comparison('win2', 'baseline', _DRIFTING + ', ')}, h AS (SELECT *, psi > lag(psi) OVER (ORDER BY feature) AS rises FROM g), sh AS (SELECT feature - lag(feature) OVER (ORDER BY feature) AS gap FROM g WHERE status = 'MATERIAL_SHIFT'),
f AS (SELECT count(*) AS n, count(*) FILTER (status = 'MATERIAL_SHIFT') AS shifts, coalesce(bool_and(rises), TRUE) AS rising, (SELECT count(*) FROM sh WHERE gap = 1) > 0 AS consecutive FROM h)
SELECT n, shifts, CASE WHEN shifts = 0 THEN 'NO_MATERIAL_SHIFT' WHEN shifts = 1 THEN 'TRANSIENT_SHIFT' WHEN n >= 3 AND rising THEN 'GRADUAL_DRIFT' WHEN TRUE THEN 'ABRUPT_SHIFT' ELSE 'PERSISTENT_SHIFT' END AS trajectory FROM f""",
    "normalized_times": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS time FROM orders",
    "source_canonicalize": "WITH c AS (SELECT lower(source) || ' vendor a' AS canonical_source, count(*) AS n FROM documents GROUP BY 1) SELECT *, left(sha256('projectsalt' || canonical_source), 16) AS pseudonym FROM c",
    "source_eligibility": "SELECT user_id, count(*) AS n, count(*) >= 65 AS eligible FROM events GROUP BY user_id",
    "source_fragmentation": """WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT count(*) AS n_groups, count(*) FILTER (n < 65) AS n_small_groups, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (n < 65), 0)::BIGINT AS n_small, round(coalesce(sum(n) FILTER (n < 65), 0)::DOUBLE / sum(n), 6) AS small_share, coalesce(sum(n) FILTER (n < 65), 0)::DOUBLE / sum(n) > 0.2 AS excessive FROM g""",
    "source_vs_reference": f"""WITH el AS (SELECT source FROM documents GROUP BY source HAVING count(*) >= 30), rf AS (SELECT min(source) AS ref FROM el),
lx AS (SELECT TRUE AS tgt, source AS feature, n_chars::DOUBLE AS value, lang FROM documents, rf WHERE source <> ref AND source IN (SELECT source FROM el)
  UNION ALL SELECT FALSE, el.source, n_chars, lang FROM documents d, rf, el WHERE d.source = ref AND el.source <> ref), l AS (SELECT tgt, feature, value FROM lx), {_KS}, {_PSI},
lc AS (SELECT feature, lang, count(*) FILTER (NOT tgt) AS r, count(*) FILTER (tgt) AS t FROM lx GROUP BY ALL),
lp AS (SELECT feature, abs(r::DOUBLE / sum(r) OVER (PARTITION BY feature) - t::DOUBLE / sum(t) OVER (PARTITION BY feature)) AS x FROM lc), lt AS (SELECT feature, sum(x) / 2 AS tvd FROM lp GROUP BY feature),
j AS (SELECT ks.*, psi, tvd, row_number() OVER (ORDER BY p, ks.feature) AS rank, count(*) OVER () AS k FROM ks JOIN psi USING (feature) JOIN lt USING (feature)),
q AS (SELECT *, least(1.0, min(p * (k::DOUBLE / rank)) OVER (ORDER BY rank DESC)) AS adj FROM j),
g AS (SELECT *, CASE WHEN adj <= 0.05 AND psi >= 0.10 THEN 'MATERIAL_SHIFT' WHEN adj <= 0.05 THEN 'SIGNIFICANT_SHIFT' ELSE 'NO_SHIFT_DETECTED' END AS status FROM q)
SELECT feature AS target, nr AS n_ref, nt AS n_target, round(ks, 6) AS ks, round(adj, 6) AS adjusted_p, round(psi, 6) AS psi, round(tvd, 6) AS label_tvd, status, tvd >= 0.15 AS confounded,
  row_number() OVER (ORDER BY CASE status WHEN 'MATERIAL_SHIFT' THEN 3 WHEN 'SIGNIFICANT_SHIFT' THEN 2 ELSE 1 END DESC, round(psi, 6) DESC, round(adj, 6), nt DESC, feature)::INTEGER AS place FROM g""",
    "five_number_profile": """SELECT event_type, count(*) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
  round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""",
    "median_mad": """WITH m AS (SELECT o_orderpriority, count(*) AS n, median(o_totalprice) AS med FROM orders GROUP BY 1)
SELECT o_orderpriority, max(n) AS n, round(max(med), 6) AS median, round(median(abs(o_totalprice - med)), 6) AS mad FROM orders JOIN m USING (o_orderpriority) GROUP BY 1""",
    "robust_z_anomalies": f"WITH {_evaluated(_SIDE)} SELECT event_id, metric, round(z, 6) AS robust_z, round(tail, 6) AS tail, status, 'ADEQUATE_SUPPORT' AS support FROM v",
    "empirical_percentiles": f"WITH {_BASE} SELECT event_id, round((le - eq / 2.0)::DOUBLE / n * 100, 6) AS percentile FROM e",
    "family_rollup": f"WITH {_evaluated(repr('T'))} SELECT event_id % 10 AS bucket, CASE WHEN metric IN ('click', 'view') THEN 'engagement' ELSE 'outcome' END AS family, count(*) AS n_metrics, count(*) AS n_valid, count(*) FILTER (status = 'ANOMALOUS') AS n_anomalous, CASE WHEN count(*) FILTER (status = 'ANOMALOUS') > 0 THEN 'ANOMALOUS' ELSE 'NORMAL' END AS status FROM v GROUP BY ALL",
}
