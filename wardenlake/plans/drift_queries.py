"""Queries of the drift operators on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..operators import drift, multiple_testing, ordered, population

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _flag():
    """Returned line items against all others."""
    return F.col("l_returnflag") == "R"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders before (reference) and from 1998 (target), labelled by priority."""
    orders = table(spark, d, "orders")
    return orders.select((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("is_target"), F.col("o_orderpriority").alias("label"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Line items returned as R (target) and all others (reference), one row a feature."""
    return drift.melt(table(spark, d, "lineitem"), _flag(), FEATURES)


def label_counts(spark, d):
    c = drift.class_counts(_orders(spark, d))
    totals = c.agg(F.sum("ref_count").alias("n_ref"), F.sum("target_count").alias("n_target"))
    p = c.crossJoin(F.broadcast(totals))  # one row
    return p.select("label", "ref_count", "target_count", F.round(F.col("ref_count") / F.col("n_ref"), 6).alias("ref_share"), F.round(F.col("target_count") / F.col("n_target"), 6).alias("target_share"))


def label_drift(spark, d):
    out = drift.categorical(_orders(spark, d))
    return out.select(*(F.round(c, 6).alias(c) for c in ("tvd", "jsd", "chi_square", "p_value")), "df", "n_ref", "n_target", F.array_join("unseen", ",").alias("unseen"), F.array_join("missing", ",").alias("missing"), "status")


def label_profile(spark, d):
    """Sizes of line items as classes, returned against all others, for each nation of their suppliers."""
    items = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    size = F.when(F.col("l_quantity") <= 2, "tiny").when(F.col("l_quantity") <= 20, "small").otherwise("large")
    out = drift.label_profile(items.select("s_nationkey", _flag().alias("is_target"), size.alias("label")), keys=["s_nationkey"])
    return out.select("s_nationkey", "n_ref", "n_target", "n_classes", *(F.round(c, 6).alias(c) for c in ("tvd", "jsd", "p_value", "imbalance_ratio")), "imbalanced", "status", "impact")


def unseen_missing_classes(spark, d):
    """Ship months that only one of the two populations has: returned before, or still open."""
    df = table(spark, d, "lineitem").select((F.col("l_linestatus") == "O").alias("is_target"), F.date_format("l_shipdate", "yyyy-MM").alias("label"))
    c = drift.class_counts(df)
    kind = F.when(F.col("ref_count") == 0, "unseen").when(F.col("target_count") == 0, "missing").otherwise("shared")
    return c.select("label", kind.alias("kind"))


def ks_two_sample(spark, d):
    return drift.ks(_items(spark, d)).select("feature", "n_ref", "n_target", F.round("ks", 6).alias("ks"), F.round("p_value", 6).alias("p_value"))


def psi_deciles(spark, d):
    return drift.psi(_items(spark, d)).select("feature", F.round("psi", 6).alias("psi"), F.col("bins").cast("int").alias("bins"))


def wasserstein_grid(spark, d):
    return drift.wasserstein(_items(spark, d)).select("feature", F.round("w1", 5).alias("w1"))


def wasserstein_equal_n(spark, d):
    """Even against odd order keys: populations of equal size, whose order statistics meet one to one."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 2 == 1).alias("is_target"), F.lit("price").alias("feature"), F.col("o_totalprice").alias("value"))
    return drift.wasserstein(o).select("feature", F.round("w1", 5).alias("w1"))


def feature_drift(spark, d):
    out = drift.features(_items(spark, d))
    order = ordered.Window.orderBy(F.when(F.col("status") == "MATERIAL_SHIFT", 0).when(F.col("status") == "SIGNIFICANT_SHIFT", 1).when(F.col("status") == "SHIFT_DETECTED", 2).otherwise(3), F.round("psi", 6).desc(), "feature")
    return out.select("feature", F.row_number().over(order).cast("int").alias("place"), F.round("ks", 6).alias("ks"), F.round("adjusted_p", 6).alias("adjusted_p"), F.round("psi", 6).alias("psi"), F.round("w1_std", 5).alias("w1_std"), "status")


def _p_values(spark, d):
    """A p-value for each supplier nation: quantities of returned A against R."""
    items = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    long = items.select(_flag().alias("is_target"), F.col("s_nationkey").cast("string").alias("feature"), F.col("l_quantity").alias("value")).where("is_target is not null")
    return drift.ks(long, ranges=1).select(F.col("feature").alias("name"), "p_value")


def _adjusted(method):
    def run(spark, d):
        return multiple_testing.adjust(_p_values(spark, d), method).select("name", F.round("p_value", 6).alias("p_value"), "rank", F.round("adjusted_p", 6).alias("adjusted_p"), F.round("critical", 6).alias("critical"), "significant")

    return run


def population_filter(spark, d):
    events = table(spark, d, "events").select(F.col("event_id").cast("string").alias("sample_id"), F.col("user_id").cast("string").alias("contributor"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("event_type").alias("class"))
    picked = population.select_population(events, contributors=[str(i) for i in range(1, 40)], start="2024-01-05", end="2024-01-20", classes=["click", "error", "view"])
    return picked.select("sample_id", "contributor", "time", "class")


def hash_rank_subsample(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"))
    return population.hash_ranked(orders, "sample_id", 500, "42")


def group_subsample(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "source")
    return population.hash_ranked(docs, "sample_id", 20, "7", ["source"])


def population_identity(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("population"), F.col("o_orderkey").cast("string").alias("sample_id"))
    return population.identity(orders, "sample_id", ["population"])


def distribution_boundary(spark, d):
    orders = table(spark, d, "orders").select((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("is_target"), F.col("o_orderpriority").alias("grp"))
    return population.boundary(orders, ["grp"])


def exact_quantiles(spark, d):
    out = ordered.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    return out.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("p05", "p25", "p50", "p75", "p95")))


def bracketed_quantiles(spark, d):
    """Lengths of the documents of each source, one of which may hold most: brackets of counts, whatever the size."""
    out = ordered.bracketed(table(spark, d, "documents"), ["source"], "n_chars", {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    return out.select("source", "n", *(F.round(c, 6).alias(c) for c in ("p05", "p25", "p50", "p75", "p95")))


QUERIES = {
    "label_counts": label_counts, "label_drift": label_drift, "label_profile": label_profile, "unseen_missing_classes": unseen_missing_classes, "ks_two_sample": ks_two_sample, "psi_deciles": psi_deciles,
    "wasserstein_grid": wasserstein_grid, "wasserstein_equal_n": wasserstein_equal_n, "feature_drift": feature_drift, "bh_fdr": _adjusted("bh"), "holm_fwer": _adjusted("holm"),
    "bonferroni": _adjusted("bonferroni"), "uncorrected": _adjusted("none"), "population_filter": population_filter, "hash_rank_subsample": hash_rank_subsample, "group_subsample": group_subsample,
    "population_identity": population_identity, "distribution_boundary": distribution_boundary, "exact_quantiles": exact_quantiles, "bracketed_quantiles": bracketed_quantiles,
}

_ORDERS = """o AS (SELECT o_orderdate >= TIMESTAMP '1998-01-01' AS tgt, o_orderpriority AS label FROM orders),
c AS (SELECT label, count(*) FILTER (NOT tgt) AS r, count(*) FILTER (tgt) AS t FROM o GROUP BY label),
n AS (SELECT sum(r)::DOUBLE AS nr, sum(t)::DOUBLE AS nt, count(*) AS k FROM c)"""
_LONG = """l AS (SELECT l_returnflag = 'R' AS tgt, f.feature, f.value FROM lineitem,
  LATERAL (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value) f
  WHERE l_returnflag IS NOT NULL)"""
_KS_P = """CASE WHEN lam <= 1e-8 THEN 1.0 WHEN lam > 5 THEN 0.0 ELSE greatest(0.0, least(1.0,
  list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0 * k * k * lam * lam))))) END"""
_KS = f"""v AS (SELECT feature, value, count(*) FILTER (NOT tgt) AS r, count(*) FILTER (tgt) AS t FROM l GROUP BY ALL),
w AS (SELECT *, sum(r) OVER a AS cr, sum(t) OVER a AS ct, sum(r) OVER b AS nr, sum(t) OVER b AS nt FROM v WINDOW a AS (PARTITION BY feature ORDER BY value), b AS (PARTITION BY feature)),
k0 AS (SELECT feature, max(nr)::BIGINT AS nr, max(nt)::BIGINT AS nt, max(abs(cr::DOUBLE / nr - ct::DOUBLE / nt)) AS ks FROM w WHERE nr > 0 AND nt > 0 GROUP BY feature),
k1 AS (SELECT *, (sqrt(nr::DOUBLE * nt / (nr + nt)) + 0.12 + 0.11 / sqrt(nr::DOUBLE * nt / (nr + nt))) * ks AS lam FROM k0),
ks AS (SELECT feature, nr, nt, ks, {_KS_P} AS p FROM k1)"""
_PSI = """e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS es FROM l WHERE NOT tgt GROUP BY feature),
pb AS (SELECT l.feature, len(list_filter(es[2:len(es) - 1], lambda x: x <= value)) AS bin, tgt FROM l JOIN e USING (feature)),
pe AS (SELECT feature, len(es) - 1 AS k, unnest(range(0, len(es) - 1)) AS bin FROM e),
pc AS (SELECT pe.feature, k, pe.bin, count(*) FILTER (NOT tgt) AS r, count(*) FILTER (tgt) AS t FROM pe LEFT JOIN pb ON pb.feature = pe.feature AND pb.bin = pe.bin GROUP BY ALL),
ps AS (SELECT *, (r + 1e-6) / (sum(r) OVER (PARTITION BY feature) + k * 1e-6) AS p, (t + 1e-6) / (sum(t) OVER (PARTITION BY feature) + k * 1e-6) AS q FROM pc),
psi AS (SELECT feature, k::INTEGER AS bins, sum((q - p) * ln(q / p)) AS psi FROM ps GROUP BY feature, k)"""
_W1 = """wr AS (SELECT feature, tgt, value, row_number() OVER (PARTITION BY feature, tgt ORDER BY value) - 1 AS i FROM l),
wn AS (SELECT feature, count(*) FILTER (NOT tgt) AS nr, count(*) FILTER (tgt) AS nt, CASE WHEN count(*) FILTER (NOT tgt) = count(*) FILTER (tgt) THEN count(*) FILTER (tgt) ELSE greatest(2000, count(*) FILTER (NOT tgt), count(*) FILTER (tgt)) END AS g FROM l GROUP BY feature),
wg AS (SELECT feature, unnest(range(0, g)) * (nr - 1)::DOUBLE / (g - 1) AS fr, unnest(range(0, g)) * (nt - 1)::DOUBLE / (g - 1) AS ft FROM wn),
w1 AS (SELECT g.feature, avg(abs((a.value + (b.value - a.value) * (fr - floor(fr))) - (c.value + (d.value - c.value) * (ft - floor(ft))))) AS w1 FROM wg g
  JOIN wr a ON a.feature = g.feature AND NOT a.tgt AND a.i = floor(fr)::BIGINT JOIN wr b ON b.feature = g.feature AND NOT b.tgt AND b.i = ceil(fr)::BIGINT
  JOIN wr c ON c.feature = g.feature AND c.tgt AND c.i = floor(ft)::BIGINT JOIN wr d ON d.feature = g.feature AND d.tgt AND d.i = ceil(ft)::BIGINT GROUP BY g.feature)"""
_GATE = "CASE WHEN sig AND prac THEN 'MATERIAL_SHIFT' WHEN sig THEN 'SIGNIFICANT_SHIFT' WHEN prac THEN 'SHIFT_DETECTED' ELSE 'NO_SHIFT_DETECTED' END"
_FAMILY = f"""l AS (SELECT l_returnflag = 'R' AS tgt, s_nationkey::VARCHAR AS feature, l_quantity AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IS NOT NULL),
{_KS}, f AS (SELECT feature AS name, p, row_number() OVER (ORDER BY p, feature) AS rank, count(*) OVER () AS k FROM ks)"""


def _adjust_sql(adjusted: str, critical: str, rank: str = "rank") -> str:
    return f"WITH {_FAMILY}, a AS (SELECT *, {adjusted} AS adj FROM f) SELECT name, round(p, 6) AS p_value, CAST({rank} AS BIGINT) AS rank, round(adj, 6) AS adjusted_p, round({critical}, 6) AS critical, adj <= 0.05 AS significant FROM a"


SQL = {
    "label_counts": f"WITH {_ORDERS} SELECT label, r AS ref_count, t AS target_count, round(r / nr, 6) AS ref_share, round(t / nt, 6) AS target_share FROM c, n",
    "label_drift": f"""WITH {_ORDERS}, p AS (SELECT *, r / nr AS p, t / nt AS q, (r / nr + t / nt) / 2 AS m, nt * (r + 1e-6) / (nr + k * 1e-6) AS ex FROM c, n),
s AS (SELECT sum(abs(p - q)) / 2 AS tvd, sum((CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2 AS jsd, sum((t - ex) * (t - ex) / ex) AS x,
  max(k) - 1 AS df, max(nr)::BIGINT AS n_ref, max(nt)::BIGINT AS n_target, coalesce(string_agg(label, ',' ORDER BY label) FILTER (r = 0 AND t > 0), '') AS unseen, coalesce(string_agg(label, ',' ORDER BY label) FILTER (r > 0 AND t = 0), '') AS missing FROM p),
u AS (SELECT *, exp(-x / 2) * (1 + x / 2) AS pv FROM s),
g AS (SELECT *, pv <= 0.05 AS sig, tvd >= 0.05 OR jsd >= 0.02 OR unseen <> '' AS prac FROM u)
SELECT round(tvd, 6) AS tvd, round(jsd, 6) AS jsd, round(x, 6) AS chi_square, round(pv, 6) AS p_value, df::INTEGER AS df, n_ref, n_target, unseen, missing, {_GATE} AS status FROM g""",
    "label_profile": f"""WITH c AS (SELECT s_nationkey, CASE WHEN l_quantity <= 2 THEN 'tiny' WHEN l_quantity <= 20 THEN 'small' ELSE 'large' END AS label, count(*) FILTER (l_returnflag <> 'R') AS r, count(*) FILTER (l_returnflag = 'R') AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
w AS (SELECT *, sum(r) OVER k AS nr, sum(t) OVER k AS nt, count(*) OVER k AS k FROM c WINDOW k AS (PARTITION BY s_nationkey)), p AS (SELECT *, r / nr AS p, t / nt AS q, (r / nr + t / nt) / 2 AS m, nt * (r + 1e-6) / (nr + k * 1e-6) AS ex FROM w),
s AS (SELECT s_nationkey, max(nr)::BIGINT AS n_ref, max(nt)::BIGINT AS n_target, count(*) FILTER (t > 0) AS n_classes, sum(abs(p - q)) / 2 AS tvd, sum((CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2 AS jsd, exp(-sum((t - ex) * (t - ex) / ex) / 2) AS pv,
  CASE WHEN count(*) FILTER (t > 0) > 1 THEN max(t) / min(t) FILTER (t > 0) END AS ratio, bool_or(r = 0 AND t > 0) AS unseen FROM p GROUP BY 1), g AS (SELECT *, pv <= 0.05 AS sig, tvd >= 0.05 OR jsd >= 0.02 OR unseen AS prac FROM s), h AS (SELECT *, {_GATE} AS status FROM g)
SELECT s_nationkey, n_ref, n_target, n_classes, round(tvd, 6) AS tvd, round(jsd, 6) AS jsd, round(pv, 6) AS p_value, round(ratio, 6) AS imbalance_ratio, coalesce(ratio >= 10, false) AS imbalanced, status,
  CASE WHEN unseen THEN 'HIGH' WHEN status = 'MATERIAL_SHIFT' THEN CASE WHEN tvd >= 0.2 THEN 'HIGH' ELSE 'MEDIUM' END WHEN status = 'SIGNIFICANT_SHIFT' THEN 'LOW' WHEN status = 'SHIFT_DETECTED' THEN 'MEDIUM' ELSE 'NEGLIGIBLE' END AS impact FROM h""",
    "unseen_missing_classes": "SELECT strftime(l_shipdate, '%Y-%m') AS label, CASE WHEN count(*) FILTER (l_linestatus <> 'O') = 0 THEN 'unseen' WHEN count(*) FILTER (l_linestatus = 'O') = 0 THEN 'missing' ELSE 'shared' END AS kind FROM lineitem GROUP BY 1",
    "ks_two_sample": f"WITH {_LONG}, {_KS} SELECT feature, nr AS n_ref, nt AS n_target, round(ks, 6) AS ks, round(p, 6) AS p_value FROM ks",
    "psi_deciles": f"WITH {_LONG}, {_PSI} SELECT feature, round(psi, 6) AS psi, bins FROM psi",
    "wasserstein_grid": f"WITH {_LONG}, {_W1} SELECT feature, round(w1, 5) AS w1 FROM w1",
    "wasserstein_equal_n": f"WITH l AS (SELECT o_orderkey % 2 = 1 AS tgt, 'price' AS feature, o_totalprice AS value FROM orders), {_W1} SELECT feature, round(w1, 5) AS w1 FROM w1",
    "feature_drift": f"""WITH {_LONG}, {_KS}, {_PSI}, {_W1}, sd AS (SELECT feature, stddev_pop(value) AS sd FROM l WHERE NOT tgt GROUP BY feature),
j AS (SELECT ks.*, psi, CASE WHEN sd > 1e-12 THEN w1 / sd ELSE w1 END AS w1s, row_number() OVER (ORDER BY p, ks.feature) AS rank, count(*) OVER () AS k FROM ks JOIN psi USING (feature) JOIN w1 USING (feature) JOIN sd USING (feature)),
q AS (SELECT *, least(1.0, min(p * (k::DOUBLE / rank)) OVER (ORDER BY rank DESC)) AS adj FROM j),
g AS (SELECT *, adj <= 0.05 AS sig, psi >= 0.10 OR w1s >= 0.10 AS prac FROM q), s AS (SELECT *, {_GATE} AS status FROM g)
SELECT feature, row_number() OVER (ORDER BY CASE status WHEN 'MATERIAL_SHIFT' THEN 0 WHEN 'SIGNIFICANT_SHIFT' THEN 1 WHEN 'SHIFT_DETECTED' THEN 2 ELSE 3 END, round(psi, 6) DESC, feature)::INTEGER AS place,
  round(ks, 6) AS ks, round(adj, 6) AS adjusted_p, round(psi, 6) AS psi, round(w1s, 5) AS w1_std, status FROM s""",
    "bh_fdr": _adjust_sql("least(1.0, min(p * (k::DOUBLE / rank)) OVER (ORDER BY rank DESC))", "rank::DOUBLE / k * 0.05"),
    "holm_fwer": _adjust_sql("max(least(1.0, p * (k - rank + 1))) OVER (ORDER BY rank)", "0.05::DOUBLE / (k - rank + 1)"),
    "bonferroni": _adjust_sql("least(1.0, p * k)", "0.05::DOUBLE / k", "1"),
    "uncorrected": _adjust_sql("p", "0.05::DOUBLE", "1"),
    "population_filter": """SELECT event_id::VARCHAR AS sample_id, user_id::VARCHAR AS contributor, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, event_type AS class FROM events
WHERE user_id BETWEEN 1 AND 39 AND strftime(ts, '%Y-%m-%d %H:%M:%S') BETWEEN '2024-01-05' AND '2024-01-20' AND event_type IN ('click', 'error', 'view')""",
    "hash_rank_subsample": "SELECT sample_id FROM (SELECT DISTINCT o_orderkey::VARCHAR AS sample_id FROM orders) ORDER BY sha256(sample_id || ':42'), sample_id LIMIT 500",
    "group_subsample": "SELECT source, sample_id FROM (SELECT DISTINCT source, doc_id::VARCHAR AS sample_id FROM documents) QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(sample_id || ':7'), sample_id) <= 20",
    "population_identity": "SELECT o_orderstatus AS population, count(DISTINCT o_orderkey) AS n, sha256(string_agg(DISTINCT o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey::VARCHAR)) AS digest FROM orders GROUP BY 1",
    "distribution_boundary": """WITH c AS (SELECT o_orderpriority AS grp, count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS n_ref, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS n_target FROM orders GROUP BY 1)
SELECT grp, n_ref, n_target, CASE WHEN n_ref = 0 OR n_target = 0 THEN 'EMPTY_POPULATION' WHEN least(n_ref, n_target) < 30 THEN 'INSUFFICIENT_DATA' ELSE 'READY' END AS status FROM c""",
    "bracketed_quantiles": "SELECT source, count(*) AS n, round(quantile_cont(n_chars, 0.05), 6) AS p05, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents WHERE n_chars IS NOT NULL GROUP BY 1",
    "exact_quantiles": "SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1",
}
