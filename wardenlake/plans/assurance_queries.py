"""Queries of integrity, evidence graphs, risk, policy, audit and paired experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..functions.shared import materialize
from ..functions.stats import round6
from ..operators import integrity, paired, risk


# --- integrity ------------------------------------------------------------------------------------------------------


def _chain(spark, d):
    """Events by user as chains."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.concat_ws(":", "event_id", "event_type").alias("payload"), F.sha2(F.col("event_id").cast("string"), 256).alias("nonce"))
    return integrity.build_chain(e, ["user_id"], "event_id", F.col("payload"))


def _tampered(spark, d):
    """Some records altered, some gone, some nonces repeated, some hashes and nonces lost."""
    c = _chain(spark, d)
    c = c.where((F.col("event_id") % 97 != 5) | (F.col("sequence_number") == 0))
    c = c.withColumn("payload", F.when(F.col("event_id") % 101 == 7, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    c = c.withColumn("nonce", F.when(F.col("event_id") % 211 == 3, F.sha2(F.lit("same"), 256)).when(F.col("event_id") % 213 != 17, F.col("nonce")))
    return c.withColumns({"record_hash": F.when(F.col("event_id") % 207 != 11, F.col("record_hash")), "previous_hash": F.when(F.col("event_id") % 209 != 13, F.col("previous_hash"))})


def hash_chain_build(spark, d):
    return _chain(spark, d).select("user_id", "event_id", "sequence_number", "previous_hash", "record_hash")


def chain_verify(spark, d):
    v = integrity.verify_chain(_tampered(spark, d), ["user_id"], F.col("payload"), time="ts")
    return v.where(F.size("codes") > 0).select("user_id", "event_id", F.array_join(F.array_sort("codes"), ",").alias("codes"))


def tamper_triage(spark, d):
    v = integrity.verify_chain(_tampered(spark, d), ["user_id"], F.col("payload"))
    return integrity.triage(v, ["user_id"])


def sequence_gaps(spark, d):
    return integrity.sequence_gaps(_tampered(spark, d), ["user_id"], "sequence_number")


def replay_nonce_dups(spark, d):
    return integrity.replays(_tampered(spark, d), ["user_id"], "nonce").select("user_id", "nonce", "n")


def _leaves(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type"), 256).alias("fp"))
    return integrity.ordered_leaves(p, "path", "fp")


def merkle_leaves(spark, d):
    return _leaves(spark, d).select(F.col("i").cast("long").alias("i"), "path", "hash")


def merkle_root(spark, d):
    levels = integrity.merkle_levels(_leaves(spark, d))
    return levels.select(F.col("level").cast("int").alias("level"), "i", "hash")


def graph_merkle(spark, d):
    p = table(spark, d, "part").select(F.sha2(F.concat_ws("|", "p_name", F.col("p_partkey").cast("string")), 256).alias("h"))
    return integrity.graph_levels(p, "h").select(F.col("level").cast("int").alias("level"), "i", "hash")


def merkle_proof_verify(spark, d):
    leaves = materialize(_leaves(spark, d), "leaves")  # ranked once, read twice
    levels = integrity.merkle_levels(leaves)
    root = levels.agg(F.max_by("hash", "level").alias("root"))  # one row
    proofs = integrity.inclusion_proofs(levels).join(leaves.select(F.col("i").cast("long").alias("i"), "path", "hash"), "i").crossJoin(F.broadcast(root))
    broken = F.when(F.col("i") % 50 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("hash"))
    return proofs.select("path", integrity.verify_proof(broken, F.col("proof"), F.col("root")).alias("valid"))


def ordered_set_hash(spark, d):
    i = table(spark, d, "lineitem").select("l_orderkey", F.sha2(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), 256).alias("h"))
    return integrity.ordered_set_hash(i, ["l_orderkey"], F.col("h"))


def tensor_diff(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_size").alias("shape"), F.col("p_brand").alias("dtype"), F.sha2("p_name", 256).alias("content"))
    k = F.col("name").cast("long")
    q = p.where(k % 13 != 0).withColumn("shape", F.when(k % 7 == 0, F.col("shape") + 1).otherwise(F.col("shape"))).withColumn("content", F.when(k % 5 == 0, F.sha2("content", 256)).otherwise(F.col("content")))
    q = q.union(p.where(k % 17 == 0).withColumn("name", F.concat(F.lit("new"), "name")))
    return integrity.snapshot_diff(p, q, "name", ["shape", "dtype"], "content")


def model_drift_class(spark, d):
    s, w, c = (F.when(F.col("p_size") % m == 0, F.lit(None).cast("boolean")).otherwise((F.col("p_partkey") / k).cast("long") % 2 == 0) for m, k in ((5, 1), (5, 2), (5, 4)))
    return table(spark, d, "part").select("p_partkey", integrity.drift_class(s, w, c).alias("state"))


# --- evidence and risk ----------------------------------------------------------------------------------------------


def _evidence(spark, d):
    """Line items as evidence: parts are assets, nations projects, orders the samples they come from."""
    i = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    pick = lambda x, values: F.element_at(F.array(*(F.lit(v) for v in values)), (x % len(values) + 1).cast("int"))
    none = F.lit(None).cast("string")
    return i.select(
        F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("project_id"), pick(F.col("l_partkey"), risk.DOMAINS).alias("domain"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"), F.when(F.col("l_partkey") % 19 == 0, "PROOF").otherwise("DETECTION").alias("layer"),
        pick(F.col("l_quantity").cast("long"), list(risk.SEVERITY)).alias("severity"), F.when(F.col("l_partkey") % 23 == 0, F.lit(None)).otherwise(F.col("l_discount") * 5).alias("confidence"),
        F.concat(F.lit("a"), (F.col("l_partkey") % 400).cast("string")).alias("asset_id"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_orderkey").cast("string")).alias("sample_id"),
        F.when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("v"), (F.col("l_orderkey") % 20).cast("string"))).alias("dataset_version_id"), none.alias("model_fingerprint"), none.alias("window_id"),
        F.when(F.col("l_orderkey") % 6 == 2, F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string"))).alias("source_id"),
    )


def evidence_normalize(spark, d):
    e = _evidence(spark, d)
    e = e.withColumn("domain", F.when(F.col("evidence_id").endswith("7"), "UNHEARD_OF").otherwise(F.col("domain"))).withColumn("confidence", F.when(F.col("evidence_id").endswith("3"), F.lit(1.5)).otherwise(F.col("confidence")))
    good, bad = risk.normalize_evidence(e)
    return good.groupBy("project_id").agg(F.count("*").alias("n")).withColumn("reason", F.lit("ACCEPTED")).union(bad.groupBy("project_id", "reason").agg(F.count("*").alias("n")).select("project_id", "n", "reason"))


def ancestry_clusters(spark, d):
    e = _evidence(spark, d)
    return e.groupBy("project_id", risk.cluster_key(F.col("evidence_id")).alias("cluster")).agg(F.count("*").alias("n")).where("n > 1")


def ancestry_links(spark, d):
    return risk.ancestry_links(_evidence(spark, d))


def domain_attenuation(spark, d):
    return risk.domain_attenuation(_evidence(spark, d))


def asset_risk(spark, d):
    e = _evidence(spark, d)
    return risk.asset_risk(e, risk.domain_attenuation(e))


def _graph(spark, d):
    """region -> nation -> supplier -> part, by every line item."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    ps = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    edges = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), F.lit(0.8).alias("weight"))
    edges = edges.union(s.select(name("n", "s_nationkey"), name("s", "s_suppkey"), F.lit(0.5))).union(ps.select(name("s", "l_suppkey"), name("p", "l_partkey"), F.lit(0.2)))
    edges = materialize(edges, "graph")  # nodes come from it, and both are read several times
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    number = F.regexp_extract("node", r"\d+", 0).cast("long")
    return nodes.withColumn("risk", (number % 10) / 10.0), edges


def dag_check(spark, d):
    nodes, edges = _graph(spark, d)
    bad = edges.union(edges.where("src like 'r%'").select("src", F.concat(F.lit("x"), "dst"), "weight")).union(nodes.where("node like 'r%'").select("node", "node", F.lit(1.0)))
    return risk.check_graph(nodes, bad)


def dag_depth(spark, d):
    nodes, edges = _graph(spark, d)
    return risk.levels(nodes, edges)


def cycle_check(spark, d):
    nodes, edges = _graph(spark, d)
    back = edges.where("src like 's%'").limit(0).union(spark.createDataFrame([("s1", "n1", 0.1), ("n1", "s1", 0.1)], "src string, dst string, weight double"))
    return risk.levels(nodes, edges.union(back)).select("node", F.col("level").isNull().alias("in_or_behind_cycle"))


def lineage_propagation(spark, d):
    nodes, edges = _graph(spark, d)
    return risk.propagate(nodes, edges).select("node", "effective")


def chain_paths(spark, d):
    nodes, edges = _graph(spark, d)
    eff = nodes.withColumnRenamed("risk", "effective")
    return risk.chain_paths(eff, edges).select(F.array_join("path", ">").alias("path"), F.col("hops").cast("int").alias("hops"), "score")


def ancestor_closure(spark, d):
    nodes, edges = _graph(spark, d)
    return risk.ancestors(edges, nodes.where("node like 'p%'"))


def _assets(spark, d):
    a = risk.asset_risk(_evidence(spark, d))
    k = F.regexp_extract("asset_id", r"\d+", 0).cast("long")
    return a.withColumn("role", F.when(k % 3 == 0, "CORE_DEPLOYED").when(k % 3 == 1, "SUPPORTING_INPUT").otherwise("PERIPHERAL_SAMPLE")).withColumn("proof_failed", (k + F.length("project_id")) % 37 == 1)


def _mild(spark, d):
    return _assets(spark, d).withColumn("risk", round6(F.col("risk") * 0.6))


def project_risk(spark, d):
    return risk.project_risk(_mild(spark, d))


def assurance_fusion(spark, d):
    e = _evidence(spark, d).withColumn("confidence", F.coalesce("confidence", F.lit(0.9)) * 0.002)
    return risk.fuse(e, {"DATASET_INTEGRITY": 0.8, "MODEL_INTEGRITY": 1.0, "DISTRIBUTION_SHIFT": 0.6})


RULES = (
    {"id": "weak", "priority": 2, "decision": "REVIEW", "conditions": [("sufficient", "EQUALS", False), ("n_clusters", "GREATER_THAN", 20)]},
    {"id": "core", "priority": 1, "decision": "QUARANTINE", "conditions": [("role", "IN", ["CORE_DEPLOYED"]), ("risk", "GREATER_EQUAL", 0.5)]},
    {"id": "level", "priority": 3, "decision": "REJECT", "conditions": [("level", "CONTAINS", "CRIT"), ("role", "NOT_EQUALS", "PERIPHERAL_SAMPLE"), ("n_evidence", "LESS_THAN", 50)]},
)


def policy_bands(spark, d):
    return _mild(spark, d).select("project_id", "asset_id", "risk", risk.band(F.col("risk")).alias("decision"))


def policy_rules_escalation(spark, d):
    out = risk.apply_policy(_mild(spark, d), RULES)
    return out.select("project_id", "asset_id", "baseline", "decision", F.array_join("matched", ",").alias("matched"), "rule")


def disposition_proof_override(spark, d):
    a = _mild(spark, d)
    return risk.disposition(risk.project_risk(a), a)


CONTROLS = (
    {"id": "C1", "domains": ["DATASET_INTEGRITY"], "layers": ["DETECTION"], "most_risk": 0.9, "proof": False},
    {"id": "C2", "domains": ["MODEL_INTEGRITY", "BACKDOOR_TRIGGER"], "layers": ["DETECTION", "PROOF"], "most_risk": 0.55, "proof": True},
    {"id": "C3", "domains": ["UNKNOWN"], "layers": [], "most_risk": 0.5, "proof": False},
)


def compliance_status(spark, d):
    p = _mild(spark, d).groupBy("project_id").agg(F.max("risk").alias("risk"), F.max("proof_failed").alias("proof_failed"))
    return risk.compliance(CONTROLS, _evidence(spark, d), p)


def report_diff(spark, d):
    a = _mild(spark, d).select(F.concat_ws("/", "project_id", "asset_id").alias("asset"), "level", F.regexp_extract("asset_id", r"\d+", 0).cast("long").alias("k"))
    b = a.where("k % 11 <> 0").withColumn("level", F.when(F.col("k") % 5 == 0, F.lit("NONE")).otherwise(F.col("level")))
    return risk.report_diff(a.where("k % 7 <> 0"), b, "asset", "level")


def findings_page(spark, d):
    e = _evidence(spark, d)
    return risk.page(e, [F.col("confidence").desc_nulls_last(), F.col("evidence_id")], 20, 30, domain="MODEL_INTEGRITY", severity="high").select("evidence_id", "project_id", F.round("confidence", 6).alias("confidence"))


def latest_version(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderkey", "o_orderpriority")
    return risk.latest_version(o, "o_custkey", "at").select("o_custkey", "o_orderkey", "o_orderpriority")


# --- paired experiments ---------------------------------------------------------------------------------------------


def _observations(spark, d):
    """Customers as samples, their market segment as candidate; success hangs on digits of their numbers."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("candidate"), F.col("c_custkey").alias("sample_id"), (F.col("c_custkey") * 7919 % 1000).alias("u"), (F.col("c_custkey") * 104729 % 1000).alias("v"))
    hit = F.when(F.col("candidate").isin("AUTOMOBILE", "BUILDING"), 900).otherwise(520)
    make = lambda name, ok: c.select("candidate", "sample_id", F.lit(name).alias("condition"), ok.cast("int").alias("success"))
    return make("trigger", F.col("u") < hit).union(make("shuffled", F.col("v") < 250)).union(make("noise", (F.col("u") + F.col("v")) % 1000 < 200))


def _paired(spark, d):
    return paired.pair_conditions(_observations(spark, d), keys=["candidate"])


def paired_tsr(spark, d):
    out = paired.success_rates(_paired(spark, d), ["candidate"])
    return out.select("candidate", "n", *(F.round(c, 6).alias(c) for c in ("tsr", "tsr_shuffled", "tsr_noise", "control", "separation", "envelope")))


def clopper_pearson(spark, d):
    from ..functions.special import clopper_pearson_lower, clopper_pearson_upper

    s = _paired(spark, d).groupBy("candidate").agg(F.sum("trigger").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    return s.select("candidate", F.round(clopper_pearson_lower("k", "n"), 6).alias("low"), F.round(clopper_pearson_upper("k", "n"), 6).alias("high"))


def permutation_iut(spark, d):
    return paired.permutation_test(_paired(spark, d), ["candidate"])


def stage2_promotion(spark, d):
    s = paired.success_rates(_paired(spark, d).withColumn("cell", F.col("sample_id") % 5), ["candidate", "cell"])
    c = s.select(F.concat_ws("-", "candidate", "cell").alias("candidate_hash"), F.col("tsr").alias("tar"), "tsr", F.round("separation", 6).alias("separation"), "n")
    return paired.promotion(c).select("candidate_hash", F.col("rank").cast("int").alias("rank"), "status")


def grid_localization_holm(spark, d):
    s = paired.success_rates(_paired(spark, d).withColumn("cell_index", (F.col("sample_id") % 64).cast("int")), ["cell_index"])
    p = F.when(F.col("n") >= 10, F.exp(-F.col("separation") * F.col("n")))
    cells = s.select("cell_index", "n", p.alias("p_value"), "separation", F.lit(False).alias("significant"))
    return paired.localize(cells).select("cell_index", "grid_row", "grid_col", F.round("adjusted_p", 6).alias("adjusted_p"), F.col("significant"))


def result_taxonomy(spark, d):
    s = paired.success_rates(_paired(spark, d).withColumn("cell", F.col("sample_id") % 7), ["candidate", "cell"])
    p = F.exp(-F.col("separation") * F.col("n") / 4)
    return s.select("candidate", "cell", paired.taxonomy(F.col("n"), F.col("tsr"), F.when(F.col("cell") != 6, F.col("tsr")), F.col("separation"), p).alias("result"))


def detection_rates(spark, d):
    r = table(spark, d, "events").select((F.col("event_type") == "error").alias("attack"), (F.col("value") > 200).alias("detected"))
    return paired.suite_rates(r).select(*(F.round(c, 6).alias(c) for c in ("detection_rate", "false_negative_rate", "false_positive_rate")))


QUERIES = {
    "hash_chain_build": hash_chain_build, "chain_verify": chain_verify, "tamper_triage": tamper_triage, "sequence_gaps": sequence_gaps, "replay_nonce_dups": replay_nonce_dups, "merkle_leaves": merkle_leaves, "graph_merkle": graph_merkle,
    "merkle_root": merkle_root, "merkle_proof_verify": merkle_proof_verify, "ordered_set_hash": ordered_set_hash, "tensor_diff": tensor_diff, "model_drift_class": model_drift_class,
    "evidence_normalize": evidence_normalize, "ancestry_clusters": ancestry_clusters, "ancestry_links": ancestry_links, "domain_attenuation": domain_attenuation, "asset_risk": asset_risk, "dag_check": dag_check,
    "dag_depth": dag_depth, "cycle_check": cycle_check, "lineage_propagation": lineage_propagation, "chain_paths": chain_paths, "ancestor_closure": ancestor_closure, "project_risk": project_risk,
    "assurance_fusion": assurance_fusion, "policy_bands": policy_bands, "policy_rules_escalation": policy_rules_escalation, "disposition_proof_override": disposition_proof_override,
    "compliance_status": compliance_status, "report_diff": report_diff, "findings_page": findings_page, "latest_version": latest_version, "paired_tsr": paired_tsr, "clopper_pearson": clopper_pearson,
    "permutation_iut": permutation_iut, "stage2_promotion": stage2_promotion, "grid_localization_holm": grid_localization_holm, "result_taxonomy": result_taxonomy, "detection_rates": detection_rates,
}

_CHAIN = """ev AS (SELECT user_id, event_id, ts, event_id || ':' || event_type AS payload, sha256(event_id::VARCHAR) AS nonce, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
ch AS (SELECT user_id, event_id, ts, payload, nonce, seq, repeat('0', 64) AS prev, sha256(repeat('0', 64) || '|' || payload) AS h FROM ev WHERE seq = 0
  UNION ALL SELECT e.user_id, e.event_id, e.ts, e.payload, e.nonce, e.seq, c.h, sha256(c.h || '|' || e.payload) FROM ch c JOIN ev e ON e.user_id = c.user_id AND e.seq = c.seq + 1)"""
_TAMPER = f"""{_CHAIN}, tp AS (SELECT user_id, event_id, seq, CASE WHEN event_id % 209 <> 13 THEN prev END AS prev, CASE WHEN event_id % 207 <> 11 THEN h END AS h, CASE WHEN event_id % 101 = 7 THEN payload || '!' ELSE payload END AS payload, CASE WHEN event_id % 211 = 3 THEN sha256('same') WHEN event_id % 213 <> 17 THEN nonce END AS nonce FROM ch WHERE event_id % 97 <> 5 OR seq = 0),
vx AS (SELECT *, row_number() OVER w - 1 AS pos, CASE WHEN row_number() OVER w = 1 THEN repeat('0', 64) ELSE lag(h) OVER w END AS lp, nonce IS NOT NULL AND row_number() OVER (PARTITION BY user_id, nonce ORDER BY seq, h) > 1 AS dn FROM tp WINDOW w AS (PARTITION BY user_id ORDER BY seq, h)),
vc AS (SELECT *, list_sort(list_filter([CASE WHEN seq > pos THEN 'SEQUENCE_GAP' END, CASE WHEN nonce IS NULL THEN 'MISSING_NONCE' WHEN dn THEN 'DUPLICATE_NONCE' END, CASE WHEN prev IS NULL OR h IS NULL THEN 'MISSING_HASH' END, CASE WHEN prev IS DISTINCT FROM lp THEN 'BROKEN_CHAIN' END, CASE WHEN sha256(concat_ws('|', prev, payload)) <> h THEN 'CONTENT_ALTERED' END], lambda x: x IS NOT NULL)) AS codes FROM vx)"""
_LEAVES = "lv AS (SELECT row_number() OVER (ORDER BY p_partkey::VARCHAR) - 1 AS i, p_partkey::VARCHAR AS path, sha256(unhex('00' || sha256(p_name || '|' || p_brand || '|' || p_type))) AS hash FROM part)"
_MERKLE = f"""{_LEAVES}, mk AS (SELECT 0 AS level, list(hash ORDER BY i) AS hs FROM lv
  UNION ALL SELECT level + 1, list_transform(range(0, (len(hs) + 1) // 2), lambda k: CASE WHEN 2 * k + 2 <= len(hs) THEN sha256(unhex('01' || hs[2 * k + 1] || hs[2 * k + 2])) ELSE hs[2 * k + 1] END) FROM mk WHERE len(hs) > 1)"""
_SEV = "CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.4 WHEN 'low' THEN 0.1 ELSE 0.05 END"
_SEVC = "CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.4 ELSE 0.2 END"
_DOM = "['DATASET_INTEGRITY', 'CONTRIBUTOR_RISK', 'MODEL_INTEGRITY', 'BEHAVIORAL_ANALYSIS', 'BACKDOOR_TRIGGER', 'INFERENCE_INTEGRITY', 'DISTRIBUTION_SHIFT']"
_EVID = f"""e AS (SELECT 'p' || s_nationkey AS project_id, ({_DOM})[(l_partkey % 7) + 1] AS domain, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS evidence_id, CASE WHEN l_partkey % 19 = 0 THEN 'PROOF' ELSE 'DETECTION' END AS layer,
  (['critical', 'high', 'medium', 'low', 'info'])[(l_quantity::BIGINT % 5) + 1] AS severity, CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_discount * 5 END AS confidence, 'a' || (l_partkey % 400) AS asset_id, CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey::VARCHAR END AS sample_id,
  CASE WHEN l_orderkey % 3 = 1 THEN 'v' || (l_orderkey % 20) END AS dataset_version_id, CASE WHEN l_orderkey % 6 = 2 THEN 's' || (l_suppkey % 10) END AS source_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
_KEY = "coalesce('anc_sample_' || sample_id, 'anc_ds_' || dataset_version_id, 'anc_src_' || source_id, 'ev_ind_' || evidence_id)"
_MATRIX = "mx AS (SELECT unnest([{}]) AS a, unnest([{}]) AS b, unnest([{}])::DOUBLE AS c)".format(
    ", ".join(f"'{a}'" for a, row in zip(risk.DOMAINS, risk.CORRELATION, strict=True) for x in row if x > 0), ", ".join(f"'{b}'" for row in risk.CORRELATION for b, x in zip(risk.DOMAINS, row, strict=True) if x > 0), ", ".join(str(x) for row in risk.CORRELATION for x in row if x > 0)
)
_ATT = f"""ds AS (SELECT project_id, domain, count(*) AS n_evidence, count(*) FILTER (layer <> 'PROOF') AS n_detection, round((coalesce(avg(least(1.0, {_SEVC} * coalesce(confidence, 0.9))) FILTER (layer <> 'PROOF'), 0))::DECIMAL(28, 12), 6)::DOUBLE AS ms FROM e GROUP BY ALL), {_MATRIX},
fx AS (SELECT s.project_id, mx.a AS domain, product(greatest(0.0, 1 - mx.c * s.ms)) AS f FROM mx JOIN ds s ON s.domain = mx.b AND s.ms > 0 GROUP BY ALL),
an AS (SELECT ds.*, CASE WHEN ms > 0 THEN round((coalesce(f, 1.0))::DECIMAL(28, 12), 6)::DOUBLE ELSE 1.0 END AS att FROM ds LEFT JOIN fx ON fx.project_id = ds.project_id AND fx.domain = ds.domain)"""


def _risk(att: str = "1.0", join: str = "") -> str:
    return f"""tm AS (SELECT e.project_id, asset_id, {_KEY} AS cl, least(1.0, {_SEV} * coalesce(confidence, CASE WHEN layer = 'PROOF' THEN 1.0 ELSE 0.9 END) * CASE WHEN layer = 'PROOF' THEN 1.0 ELSE {att} END) AS t FROM e {join}),
cs AS (SELECT project_id, asset_id, cl, count(*) AS k, round((least(1.0, max(t) + 0.15 * (sum(t) - max(t))))::DECIMAL(28, 12), 6)::DOUBLE AS s FROM tm GROUP BY ALL),
ar AS (SELECT project_id, asset_id, round((least(1.0, greatest(0.0, 1 - product(1 - s))))::DECIMAL(28, 12), 6)::DOUBLE AS risk, sum(k)::BIGINT AS n_evidence, count(*) AS n_clusters, NOT bool_or(starts_with(cl, 'ev_ind_')) AS sufficient FROM cs GROUP BY ALL),
al AS (SELECT *, CASE WHEN risk >= 0.85 THEN 'CRITICAL' WHEN risk >= 0.65 THEN 'HIGH' WHEN risk >= 0.3 THEN 'MEDIUM' WHEN risk > 0 THEN 'LOW' ELSE 'NONE' END AS level FROM ar)"""


_MILD = f"""{_EVID}, {_risk()}, am AS (SELECT * REPLACE (round((risk * 0.6)::DECIMAL(28, 12), 6)::DOUBLE AS risk), CASE asset_id[2:]::INTEGER % 3 WHEN 0 THEN 'CORE_DEPLOYED' WHEN 1 THEN 'SUPPORTING_INPUT' ELSE 'PERIPHERAL_SAMPLE' END AS role, (asset_id[2:]::INTEGER + length(project_id)) % 37 = 1 AS proof_failed FROM al)"""
_BAND = "CASE WHEN {0} < 0.3 THEN 'ACCEPT' WHEN {0} < 0.65 THEN 'REVIEW' WHEN {0} < 0.85 THEN 'QUARANTINE' ELSE 'REJECT' END"
_PROJECT = """pr AS (SELECT project_id, round(greatest(0.0, least(1.0, 1 - pow(1 - max(risk), 1.5) * product(1 - 0.1 * CASE role WHEN 'CORE_DEPLOYED' THEN 1.0 WHEN 'SUPPORTING_INPUT' THEN 0.75 ELSE 0.5 END * risk))) + 1.37e-10, 6) AS risk, round(max(risk) + 1.37e-10, 6) AS peak,
  arg_max(asset_id, {'r': risk, 'a': asset_id}) AS peak_asset, count(*) AS n_assets FROM am GROUP BY 1)"""
_GRAPH = """ed AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 0.8::DOUBLE AS w FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 0.5 FROM supplier UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 0.2 FROM lineitem),
nd AS (SELECT node, (node[2:]::BIGINT % 10) / 10.0::DOUBLE AS risk FROM (SELECT src AS node FROM ed UNION SELECT dst FROM ed))"""
_PAIRED = """cu AS (SELECT c_mktsegment AS candidate, c_custkey AS sample_id, c_custkey * 7919 % 1000 AS u, c_custkey * 104729 % 1000 AS v FROM customer),
pp AS (SELECT candidate, sample_id, (u < CASE WHEN candidate IN ('AUTOMOBILE', 'BUILDING') THEN 900 ELSE 520 END)::INTEGER AS tr, (v < 250)::INTEGER AS sh, ((u + v) % 1000 < 200)::INTEGER AS no FROM cu)"""
_TSR = "sr AS (SELECT {0}, count(*) AS n, avg(tr) AS tsr, avg(sh) AS ts, avg(no) AS tn, avg(greatest(sh, no)) AS env, greatest(avg(sh), avg(no)) AS ctl, avg(tr) - greatest(avg(sh), avg(no)) AS sep FROM pp GROUP BY ALL)"

SQL = {
    "hash_chain_build": f"WITH RECURSIVE {_CHAIN} SELECT user_id, event_id, seq AS sequence_number, prev AS previous_hash, h AS record_hash FROM ch",
    "chain_verify": f"WITH RECURSIVE {_TAMPER} SELECT user_id, event_id, array_to_string(codes, ',') AS codes FROM vc WHERE len(codes) > 0",
    "tamper_triage": f"""WITH RECURSIVE {_TAMPER}, x AS (SELECT user_id, seq, unnest(codes) AS code FROM vc)
SELECT user_id, count(*) AS n_failures, min(seq) AS first_failed, CASE WHEN bool_or(code IN ('CONTENT_ALTERED', 'MISSING_HASH')) THEN 'CONTENT_TAMPERING' WHEN bool_or(code = 'DUPLICATE_NONCE') THEN 'REPLAY' WHEN bool_or(code = 'SEQUENCE_GAP') THEN 'DELETION' ELSE 'REORDERING' END AS kind FROM x GROUP BY 1""",
    "sequence_gaps": f"WITH RECURSIVE {_TAMPER}, g AS (SELECT user_id, seq, lead(seq) OVER (PARTITION BY user_id ORDER BY seq) AS nx FROM tp) SELECT user_id, seq AS after, nx - seq - 1 AS n_missing FROM g WHERE nx > seq + 1",
    "replay_nonce_dups": f"WITH RECURSIVE {_TAMPER} SELECT user_id, nonce, count(*) AS n FROM tp GROUP BY ALL HAVING count(*) > 1",
    "merkle_leaves": f"WITH {_LEAVES} SELECT i, path, hash FROM lv",
    "graph_merkle": """WITH RECURSIVE t AS (SELECT 0 AS level, list(h ORDER BY h) AS hs FROM (SELECT sha256(p_name || '|' || p_partkey) AS h FROM part)
  UNION ALL SELECT level + 1, list_transform(range(0, (len(hs) + 1) // 2), lambda k: sha256(hs[2 * k + 1] || coalesce(hs[2 * k + 2], hs[2 * k + 1]))) FROM t WHERE len(hs) > 1)
SELECT level, unnest(range(len(hs)))::BIGINT AS i, unnest(hs) AS hash FROM t""",
    "merkle_root": f"WITH RECURSIVE {_MERKLE} SELECT level, unnest(range(0, len(hs))) AS i, unnest(hs) AS hash FROM mk",
    "merkle_proof_verify": f"WITH {_LEAVES} SELECT path, i % 50 <> 0 AS valid FROM lv",
    "ordered_set_hash": "SELECT l_orderkey, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT l_orderkey, sha256(l_partkey || '|' || l_suppkey) AS h FROM lineitem) GROUP BY 1",
    "tensor_diff": """WITH p AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS name, p_size AS shape, p_brand AS dtype, sha256(p_name) AS content FROM part),
q AS (SELECT name, CASE WHEN k % 7 = 0 THEN shape + 1 ELSE shape END AS shape, dtype, CASE WHEN k % 5 = 0 THEN sha256(content) ELSE content END AS content FROM p WHERE k % 13 <> 0 UNION ALL SELECT 'new' || name, shape, dtype, content FROM p WHERE k % 17 = 0)
SELECT coalesce(p.name, q.name) AS name, CASE WHEN p.name IS NULL THEN 'ADDED' WHEN q.name IS NULL THEN 'REMOVED' WHEN (p.shape <> q.shape OR p.dtype <> q.dtype) AND p.content <> q.content THEN 'CONTENT_AND_METADATA_CHANGED' WHEN p.content <> q.content THEN 'CONTENT_CHANGED'
  WHEN p.shape <> q.shape OR p.dtype <> q.dtype THEN 'METADATA_CHANGED' ELSE 'UNCHANGED' END AS change FROM p FULL JOIN q ON p.name = q.name""",
    "model_drift_class": """WITH x AS (SELECT p_partkey, p_size % 5 = 0 AS un, p_partkey % 2 = 0 AS s, (p_partkey // 2) % 2 = 0 AS w, (p_partkey // 4) % 2 = 0 AS c FROM part)
SELECT p_partkey, CASE WHEN un THEN 'DRIFT_UNAVAILABLE' ELSE CASE WHEN NOT s AND NOT w AND NOT c THEN 'EXACT_INTEGRITY_MATCH' WHEN NOT s AND w AND NOT c THEN 'WEIGHT_ONLY_DRIFT' WHEN s AND NOT w AND NOT c THEN 'STRUCTURAL_ONLY_DRIFT' WHEN NOT s AND NOT w AND c THEN 'CONTRACT_ONLY_DRIFT'
  WHEN s AND w AND NOT c THEN 'STRUCTURAL_AND_WEIGHT_DRIFT' WHEN s AND NOT w AND c THEN 'STRUCTURAL_AND_CONTRACT_DRIFT' WHEN NOT s AND w AND c THEN 'WEIGHT_AND_CONTRACT_DRIFT' ELSE 'STRUCTURAL_WEIGHT_CONTRACT_DRIFT' END END AS state FROM x""",
    "evidence_normalize": f"""WITH {_EVID}, x AS (SELECT * REPLACE (CASE WHEN evidence_id LIKE '%7' THEN 'UNHEARD_OF' ELSE domain END AS domain, CASE WHEN evidence_id LIKE '%3' THEN 1.5 ELSE confidence END AS confidence) FROM e),
r AS (SELECT *, CASE WHEN domain = 'UNHEARD_OF' THEN 'UNKNOWN_DOMAIN' WHEN confidence > 1 THEN 'CONFIDENCE_OUT_OF_RANGE' END AS reason FROM x)
SELECT project_id, count(DISTINCT {{'d': domain, 'l': layer, 's': severity, 'c': confidence, 'a': asset_id, 'x': sample_id, 'y': dataset_version_id, 'z': source_id}}) AS n, 'ACCEPTED' AS reason FROM r WHERE reason IS NULL GROUP BY 1
UNION ALL SELECT project_id, count(*), reason FROM r WHERE reason IS NOT NULL GROUP BY 1, 3""",
    "ancestry_clusters": f"WITH {_EVID} SELECT project_id, {_KEY} AS cluster, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 1",
    "ancestry_links": f"""WITH {_EVID}, k AS (SELECT project_id, evidence_id, 'anc_sample_' || sample_id AS key FROM e WHERE sample_id IS NOT NULL UNION ALL SELECT project_id, evidence_id, 'anc_ds_' || dataset_version_id FROM e WHERE dataset_version_id IS NOT NULL UNION ALL SELECT project_id, evidence_id, 'anc_src_' || source_id FROM e WHERE source_id IS NOT NULL),
m AS (SELECT *, min(evidence_id) OVER (PARTITION BY project_id, key) AS b FROM k) SELECT DISTINCT project_id, evidence_id AS a, b FROM m WHERE evidence_id <> b""",
    "domain_attenuation": f"WITH {_EVID}, {_ATT} SELECT project_id, domain, n_evidence, n_detection, ms AS mean_severity, att AS attenuation, round((ms * att)::DECIMAL(28, 12), 6)::DOUBLE AS damped FROM an",
    "asset_risk": f"WITH {_EVID}, {_ATT}, {_risk('att', 'JOIN an ON an.project_id = e.project_id AND an.domain = e.domain')} SELECT * FROM al",
    "dag_check": f"WITH {_GRAPH} SELECT 'DANGLING_EDGE' AS code, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'SELF_LOOP', (SELECT count(*) FROM nd WHERE node LIKE 'r%') UNION ALL SELECT 'TOO_MANY_BRANCHES', (SELECT count(*) FROM (SELECT src FROM ed GROUP BY 1 HAVING count(*) > 100))",
    "dag_depth": f"WITH RECURSIVE {_GRAPH}, dp AS (SELECT node, 0 AS level FROM nd WHERE node NOT IN (SELECT dst FROM ed) UNION SELECT dst, level + 1 FROM dp JOIN ed ON src = node) SELECT node, max(level) AS level FROM dp GROUP BY 1",
    "cycle_check": f"WITH RECURSIVE {_GRAPH}, bk AS (SELECT 's1' AS node UNION SELECT 'n1'), rc AS (SELECT node FROM bk UNION SELECT dst FROM rc JOIN ed ON src = node) SELECT node, node IN (SELECT node FROM rc) AS in_or_behind_cycle FROM nd",
    "lineage_propagation": f"""WITH {_GRAPH}, l0 AS (SELECT node, round((risk)::DECIMAL(28, 12), 6)::DOUBLE AS eff FROM nd WHERE node LIKE 'r%'),
l1 AS (SELECT n.node, round((1 - (1 - max(n.risk)) * product(1 - 0.25 * w * p.eff))::DECIMAL(28, 12), 6)::DOUBLE AS eff FROM nd n JOIN ed ON dst = n.node JOIN l0 p ON p.node = src GROUP BY 1), l2 AS (SELECT n.node, round((1 - (1 - max(n.risk)) * product(1 - 0.25 * w * p.eff))::DECIMAL(28, 12), 6)::DOUBLE AS eff FROM nd n JOIN ed ON dst = n.node JOIN l1 p ON p.node = src GROUP BY 1),
l3 AS (SELECT n.node, round((1 - (1 - max(n.risk)) * product(1 - 0.25 * w * p.eff))::DECIMAL(28, 12), 6)::DOUBLE AS eff FROM nd n JOIN ed ON dst = n.node JOIN l2 p ON p.node = src GROUP BY 1) SELECT node, eff AS effective FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3)""",
    "chain_paths": f"""WITH RECURSIVE {_GRAPH}, hp AS (SELECT src, dst, 0.25 * a.risk * b.risk AS h FROM ed JOIN nd a ON a.node = src JOIN nd b ON b.node = dst), pa AS (SELECT src || '>' || dst AS path, dst AS fin, 1 AS hops, 1 - h AS k FROM hp UNION ALL SELECT path || '>' || dst, dst, hops + 1, k * (1 - h) FROM pa JOIN hp ON src = fin WHERE hops < 4)
SELECT path, hops, round((1 - k)::DECIMAL(28, 12), 6)::DOUBLE AS score FROM pa""",
    "ancestor_closure": f"WITH RECURSIVE {_GRAPH}, up AS (SELECT node AS start, node FROM nd WHERE node LIKE 'p%' UNION SELECT start, src FROM up JOIN ed ON dst = node) SELECT start, node FROM up WHERE start <> node",
    "project_risk": f"WITH {_MILD}, {_PROJECT} SELECT *, CASE WHEN risk >= 0.85 THEN 'CRITICAL' WHEN risk >= 0.65 THEN 'HIGH' WHEN risk >= 0.3 THEN 'MEDIUM' WHEN risk > 0 THEN 'LOW' ELSE 'NONE' END AS level FROM pr",
    "assurance_fusion": f"""WITH {_EVID}, x AS (SELECT *, CASE domain WHEN 'DATASET_INTEGRITY' THEN 0.8 WHEN 'MODEL_INTEGRITY' THEN 1.0 WHEN 'DISTRIBUTION_SHIFT' THEN 0.6 ELSE 0.5 END * {_SEVC} * (coalesce(confidence, 0.9) * 0.002) AS t FROM e),
c AS (SELECT project_id, asset_id, domain, least(1.0, max(t) + 0.1 * (sum(t) - max(t))) AS s FROM x GROUP BY ALL), g AS (SELECT project_id, 1 - product(1 - s) AS risk, count(*) AS n_clusters FROM c GROUP BY 1), b AS (SELECT DISTINCT project_id FROM x WHERE layer = 'PROOF' AND severity IN ('critical', 'high'))
SELECT g.project_id, round((risk)::DECIMAL(28, 12), 6)::DOUBLE AS risk, CASE WHEN risk >= 0.85 THEN 'CRITICAL' WHEN risk >= 0.65 THEN 'HIGH' WHEN risk >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN b.project_id IS NOT NULL THEN 'QUARANTINE' WHEN risk < 0.3 THEN 'ACCEPT' WHEN risk < 0.65 THEN 'REVIEW' ELSE 'QUARANTINE' END AS disposition, n_clusters FROM g LEFT JOIN b USING (project_id)""",
    "policy_bands": f"WITH {_MILD} SELECT project_id, asset_id, risk, {_BAND.format('risk')} AS decision FROM am",
    "policy_rules_escalation": f"""WITH {_MILD}, r AS (SELECT *, {_BAND.format('risk')} AS baseline, role = 'CORE_DEPLOYED' AND risk >= 0.5 AS core, NOT sufficient AND n_clusters > 20 AS weak, level LIKE '%CRIT%' AND role <> 'PERIPHERAL_SAMPLE' AND n_evidence < 50 AS lv FROM am),
s AS (SELECT *, CASE WHEN lv THEN 4 WHEN core THEN 3 WHEN weak THEN 2 ELSE 0 END AS top, list_position(['ACCEPT', 'REVIEW', 'QUARANTINE', 'REJECT'], baseline) AS b FROM r)
SELECT project_id, asset_id, baseline, CASE WHEN top > b THEN (['ACCEPT', 'REVIEW', 'QUARANTINE', 'REJECT'])[top] ELSE baseline END AS decision, array_to_string(list_filter([CASE WHEN core THEN 'core' END, CASE WHEN weak THEN 'weak' END, CASE WHEN lv THEN 'level' END], lambda x: x IS NOT NULL), ',') AS matched,
  CASE WHEN top > b THEN CASE top WHEN 4 THEN 'level' WHEN 3 THEN 'core' ELSE 'weak' END END AS rule FROM s""",
    "disposition_proof_override": f"""WITH {_MILD}, {_PROJECT}, bd AS (SELECT project_id, bool_or(role = 'CORE_DEPLOYED') AS core, bool_or(role = 'PERIPHERAL_SAMPLE') AS edge FROM am WHERE proof_failed GROUP BY 1), j AS (SELECT pr.*, {_BAND.format('risk')} AS baseline, coalesce(core, FALSE) AS core, coalesce(edge, FALSE) AS edge FROM pr LEFT JOIN bd USING (project_id))
SELECT project_id, risk, baseline, CASE WHEN core THEN 'REJECT' WHEN edge AND baseline IN ('ACCEPT', 'REVIEW') THEN 'QUARANTINE' ELSE baseline END AS decision, core OR edge AS proof_override FROM j""",
    "compliance_status": f"""WITH {_MILD}, p AS (SELECT project_id, max(risk) AS risk, bool_or(proof_failed) AS pf FROM am GROUP BY 1), ct AS (SELECT unnest([{{'id': 'C1', 'd': ['DATASET_INTEGRITY'], 'l': ['DETECTION'], 'm': 0.9, 'p': FALSE}}, {{'id': 'C2', 'd': ['MODEL_INTEGRITY', 'BACKDOOR_TRIGGER'], 'l': ['DETECTION', 'PROOF'], 'm': 0.55, 'p': TRUE}}, {{'id': 'C3', 'd': ['UNKNOWN'], 'l': []::VARCHAR[], 'm': 0.5, 'p': FALSE}}]) AS c),
j AS (SELECT p.*, c, (SELECT count(*) FROM e WHERE e.project_id = p.project_id AND list_contains(c.d, e.domain)) AS n, (SELECT list(DISTINCT layer) FROM e WHERE e.project_id = p.project_id AND list_contains(c.d, e.domain)) AS ls FROM p, ct)
SELECT project_id, c.id AS control_id, CASE WHEN n = 0 THEN 'UNAVAILABLE' WHEN pf AND c.p THEN 'NON_COMPLIANT' WHEN risk > c.m THEN CASE WHEN risk >= 0.7 THEN 'NON_COMPLIANT' ELSE 'PARTIALLY_COMPLIANT' END WHEN len(list_filter(c.l, lambda x: NOT list_contains(ls, x))) > 0 THEN 'PARTIALLY_COMPLIANT' ELSE 'COMPLIANT' END AS status, n AS n_evidence FROM j""",
    "report_diff": f"""WITH {_MILD}, a AS (SELECT project_id || '/' || asset_id AS asset, level, asset_id[2:]::INTEGER AS k FROM am), x AS (SELECT asset, level FROM a WHERE k % 7 <> 0), y AS (SELECT asset, CASE WHEN k % 5 = 0 THEN 'NONE' ELSE level END AS level FROM a WHERE k % 11 <> 0)
SELECT * FROM (SELECT coalesce(x.asset, y.asset) AS asset, CASE WHEN x.asset IS NULL THEN 'ADDED' WHEN y.asset IS NULL THEN 'REMOVED' WHEN x.level <> y.level THEN 'CHANGED' END AS change, x.level AS before, y.level AS after FROM x FULL JOIN y ON x.asset = y.asset) WHERE change IS NOT NULL""",
    "findings_page": f"WITH {_EVID} SELECT evidence_id, project_id, round(confidence, 6) AS confidence FROM e WHERE domain = 'MODEL_INTEGRITY' AND severity = 'high' ORDER BY e.confidence DESC NULLS LAST, evidence_id LIMIT 30 OFFSET 20",
    "latest_version": "SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey, arg_max(o_orderpriority, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderpriority FROM orders GROUP BY 1",
    "paired_tsr": f"WITH {_PAIRED}, {_TSR.format('candidate')} SELECT candidate, n, round(tsr, 6) AS tsr, round(ts, 6) AS tsr_shuffled, round(tn, 6) AS tsr_noise, round(ctl, 6) AS control, round(sep, 6) AS separation, round(env, 6) AS envelope FROM sr",
    "stage2_promotion": f"""WITH {_PAIRED.replace('AS no FROM cu', 'AS no, sample_id % 5 AS cell FROM cu')}, {_TSR.format('candidate, cell')}, g AS (SELECT candidate || '-' || cell AS ch, n, tsr, round(sep, 6) AS sep, CASE WHEN n < 10 THEN 'INSUFFICIENT_SUPPORT' WHEN tsr < 0.5 THEN 'NOT_PROMOTED_LOW_TAR' WHEN round(sep, 6) <= 0.2 THEN 'NOT_PROMOTED_LOW_SEPARATION' END AS gate FROM sr),
k AS (SELECT *, CASE WHEN gate IS NULL THEN row_number() OVER (PARTITION BY gate IS NULL ORDER BY sep DESC, tsr DESC, ch) END AS rank FROM g) SELECT ch AS candidate_hash, rank::INTEGER AS rank, coalesce(gate, CASE WHEN rank <= 2 THEN 'PROMOTED' ELSE 'NOT_PROMOTED_RANK_EXCEEDED' END) AS status FROM k""",
    "grid_localization_holm": f"""WITH {_PAIRED.replace('AS no FROM cu', 'AS no, (sample_id % 64)::INTEGER AS cell FROM cu')}, {_TSR.format('cell')}, p AS (SELECT cell, CASE WHEN n >= 10 THEN exp(-sep * n) END AS p FROM sr), t AS (SELECT cell, p, row_number() OVER (ORDER BY p, cell) AS rank, count(*) OVER () AS k FROM p WHERE p IS NOT NULL),
h AS (SELECT cell, max(least(1.0, least(1.0, p) * (k - rank + 1))) OVER (ORDER BY rank) AS adj FROM t) SELECT p.cell AS cell_index, (p.cell // 8)::INTEGER AS grid_row, (p.cell % 8)::INTEGER AS grid_col, round(adj, 6) AS adjusted_p, adj < 0.05 AS significant FROM p LEFT JOIN h USING (cell)""",
    "result_taxonomy": f"""WITH {_PAIRED.replace('AS no FROM cu', 'AS no, sample_id % 7 AS cell FROM cu')}, {_TSR.format('candidate, cell')}, q AS (SELECT *, exp(-sep * n / 4) AS p FROM sr)
SELECT candidate, cell, CASE WHEN n < 10 THEN 'INSUFFICIENT_SUPPORT' WHEN cell = 6 THEN CASE WHEN tsr >= 0.7 AND p < 0.05 THEN 'TRIGGER_CANDIDATE_OBSERVED' ELSE 'NO_TRIGGER_EVIDENCE' END WHEN n >= 100 AND tsr >= 0.9 AND sep >= 0.6 AND p < 0.001 THEN 'STRONG_TRIGGER_CONSISTENCY'
  WHEN n >= 30 AND tsr >= 0.7 AND sep >= 0.4 AND p < 0.05 THEN 'TARGETED_EFFECT_DETECTED' WHEN p < 0.05 AND sep > 0 THEN 'TRIGGER_CANDIDATE_OBSERVED' WHEN tsr > 0 AND sep <= 0 THEN 'NORMAL_SENSITIVITY_ONLY' ELSE 'NO_TRIGGER_EVIDENCE' END AS result FROM q""",
    "detection_rates": "SELECT round(avg((value > 200)::INTEGER) FILTER (event_type = 'error'), 6) AS detection_rate, round(avg((value <= 200)::INTEGER) FILTER (event_type = 'error'), 6) AS false_negative_rate, round(avg((value > 200)::INTEGER) FILTER (event_type <> 'error'), 6) AS false_positive_rate FROM events",
}
