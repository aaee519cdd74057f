"""Evidence graphs, risk, policy, and audit.

Evidence rows: project_id, domain, evidence_id, finding_id, layer (DETECTION or PROOF), severity, confidence, asset_id, and the five
ancestry columns sample_id, dataset_version_id, model_fingerprint, window_id, source_id."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import discard, fresh_path, materialize
from ..functions.stats import clamp, noisy_or, risk_level, round6

# Fixed values.
SEVERITY = {"critical": 1.00, "high": 0.70, "medium": 0.40, "low": 0.10, "info": 0.05}
SEVERITY_BY_CLASS = {"critical": 1.0, "high": 0.8, "medium": 0.6, "low": 0.4, "info": 0.2}
DOMAINS = ("DATASET_INTEGRITY", "CONTRIBUTOR_RISK", "MODEL_INTEGRITY", "BEHAVIORAL_ANALYSIS", "BACKDOOR_TRIGGER", "INFERENCE_INTEGRITY", "DISTRIBUTION_SHIFT")
CORRELATION = (
    (0.00, 0.30, 0.25, 0.15, 0.40, 0.10, 0.35),
    (0.30, 0.00, 0.20, 0.10, 0.35, 0.05, 0.15),
    (0.25, 0.20, 0.00, 0.45, 0.40, 0.30, 0.25),
    (0.15, 0.10, 0.45, 0.00, 0.35, 0.40, 0.30),
    (0.40, 0.35, 0.40, 0.35, 0.00, 0.25, 0.20),
    (0.10, 0.05, 0.30, 0.40, 0.25, 0.00, 0.35),
    (0.35, 0.15, 0.25, 0.30, 0.20, 0.35, 0.00),
)
ROLES = {"CORE_DEPLOYED": 1.0, "SUPPORTING_INPUT": 0.75, "PERIPHERAL_SAMPLE": 0.50}
BANDS = ((0.30, "ACCEPT"), (0.65, "REVIEW"), (0.85, "QUARANTINE"), (1.01, "REJECT"))
DECISIONS = ("ACCEPT", "REVIEW", "QUARANTINE", "REJECT")
GAMMA, PEAK, INTER, INTRA, DEPTH = 0.25, 1.50, 0.10, 0.15, 5
ANCESTRY = (("sample_id", "anc_sample_"), ("dataset_version_id", "anc_ds_"), ("model_fingerprint", "anc_model_"), ("window_id", "anc_win_"), ("source_id", "anc_src_"))


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain(*values.items())))


def severity_weight(severity: Column, values: dict[str, float] = SEVERITY, other: float = 0.05) -> Column:
    return F.coalesce(F.try_element_at(_map(values), F.lower(severity)), F.lit(other))


def normalize_evidence(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with content_hash, the first of equal ones; rejected rows with a reason)."""
    reason = (
        F.when(F.col("evidence_id").isNull() | (F.trim("evidence_id") == ""), "MISSING_ID").when(~F.col("domain").isin(*DOMAINS) | F.col("domain").isNull(), "UNKNOWN_DOMAIN")
        .when(F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1), "CONFIDENCE_OUT_OF_RANGE")
    )
    marked = rows.withColumn("reason", reason)
    content = [c for c in sorted(rows.columns) if c != "evidence_id"]
    good = marked.where("reason is null").drop("reason").withColumn("content_hash", F.sha2(F.to_json(F.struct(*content)), 256))
    best = good.groupBy("project_id", "content_hash").agg(F.min("evidence_id").alias("evidence_id"))
    return good.join(best, ["project_id", "content_hash", "evidence_id"], "left_semi").dropDuplicates(["project_id", "content_hash"]), marked.where("reason is not null")


def cluster_key(independent: Column) -> Column:
    """The first ancestry key that isn't empty, or a cluster of its own."""
    return F.coalesce(*(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(p), F.substring(F.col(c), 1, 16) if c == "model_fingerprint" else F.col(c))) for c, p in ANCESTRY), F.concat(F.lit("ev_ind_"), independent))


def ancestry_links(evidence: DataFrame) -> DataFrame:
    """a, b: pairs of evidence that share any non-empty ancestry key: an equality join for each key, united (an OR in one join would be a
    nested loop). Hot keys make a star to their least member, not all pairs."""
    out = None
    for c, p in ANCESTRY:
        own = evidence.where(F.coalesce(F.col(c), F.lit("")) != "").select("project_id", F.concat(F.lit(p), F.col(c)).alias("key"), "evidence_id")
        out = own if out is None else out.union(own)
    least = out.groupBy("project_id", "key").agg(F.min("evidence_id").alias("b"))
    return out.join(least, ["project_id", "key"]).where("evidence_id <> b").select("project_id", F.col("evidence_id").alias("a"), "b").distinct()


def domain_attenuation(evidence: DataFrame, matrix: Sequence[Sequence[float]] = CORRELATION) -> DataFrame:
    """project_id, domain, n_evidence, n_detection, mean_severity, attenuation, damped: seven rows a project at most."""
    spark = evidence.sparkSession
    detect = F.col("layer") != "PROOF"
    term = clamp(severity_weight(F.col("severity"), SEVERITY_BY_CLASS, 0.2) * F.coalesce("confidence", F.lit(0.9)))
    s = evidence.groupBy("project_id", "domain").agg(F.count("*").alias("n_evidence"), F.sum(detect.cast("long")).alias("n_detection"), round6(clamp(F.coalesce(F.avg(F.when(detect, term)), F.lit(0.0)))).alias("mean_severity"))
    m = spark.createDataFrame([(a, b, float(x)) for a, row in zip(DOMAINS, matrix, strict=True) for b, x in zip(DOMAINS, row, strict=True) if x > 0], "domain string, other string, c double")
    source = s.where("mean_severity > 0").select("project_id", F.col("domain").alias("other"), F.col("mean_severity").alias("s"))
    factor = m.join(source, "other").groupBy("project_id", "domain").agg(F.product(clamp(1 - F.col("c") * F.col("s"))).alias("f"))
    out = s.join(factor, ["project_id", "domain"], "left")
    att = F.when(F.col("mean_severity") > 0, round6(clamp(F.coalesce("f", F.lit(1.0))))).otherwise(1.0)
    return out.withColumn("attenuation", att).withColumn("damped", round6(F.col("mean_severity") * F.col("attenuation"))).drop("f")


def asset_risk(evidence: DataFrame, attenuation: DataFrame | None = None, damping: float = INTRA, weights: dict[str, float] = SEVERITY) -> DataFrame:
    """project_id, asset_id, risk, level, n_evidence, n_clusters, sufficient: terms damped within ancestry clusters, clusters joined by noisy-or.
    Proof evidence is never attenuated."""
    e = evidence.withColumn("cluster", cluster_key(F.col("evidence_id"))).withColumn("alone", F.col("cluster").startswith("ev_ind_"))
    if attenuation is not None:
        e = e.join(attenuation.select("project_id", "domain", "attenuation"), ["project_id", "domain"], "left")
    att = F.when(F.col("layer") == "PROOF", 1.0).otherwise(F.coalesce("attenuation", F.lit(1.0))) if attenuation is not None else F.lit(1.0)
    conf = F.coalesce("confidence", F.when(F.col("layer") == "PROOF", 1.0).otherwise(0.9))
    e = e.withColumn("term", clamp(severity_weight(F.col("severity"), weights) * conf * att))
    c = e.groupBy("project_id", "asset_id", "cluster").agg(F.max("term").alias("m"), F.sum("term").alias("s"), F.count("*").alias("k"), F.max("alone").alias("alone"))
    c = c.withColumn("score", round6(clamp(F.col("m") + damping * (F.col("s") - F.col("m")))))
    out = c.groupBy("project_id", "asset_id").agg(round6(clamp(noisy_or(F.col("score")))).alias("risk"), F.sum("k").alias("n_evidence"), F.count("*").alias("n_clusters"), (~F.max("alone")).alias("sufficient"))
    return out.withColumn("level", risk_level(F.col("risk")))


def check_graph(nodes: DataFrame, edges: DataFrame, most_branches: int = 100) -> DataFrame:
    """code, n of what is wrong: dangling edges, self loops, nodes with too many branches."""
    ids = nodes.select(F.col("node").alias("id")).distinct()
    dangling = edges.join(ids, F.col("src") == F.col("id"), "left_anti").union(edges.join(ids, F.col("dst") == F.col("id"), "left_anti")).distinct()
    wide = edges.groupBy("src").agg(F.count("*").alias("k")).where(F.col("k") > most_branches)
    one = lambda code, df: df.agg(F.lit(code).alias("code"), F.count("*").alias("n"))
    return one("DANGLING_EDGE", dangling).union(one("SELF_LOOP", edges.where("src = dst"))).union(one("TOO_MANY_BRANCHES", wide))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level: the longest way from a root. Nodes in or behind a cycle have a null level.

    Edges of unknown nodes count for nothing. In-degree counters: a node is free once all its edges have been counted off. A round joins the nodes freed last with the edges and adds to the counters of
    those they touch; it writes the nodes it frees, each once in all, and the counters of nodes half counted, and leaves all other tables as they are."""
    spark = nodes.sparkSession
    ids = materialize(nodes.where("node is not null").select("node").distinct(), "nodes")
    live = materialize(edges.where("dst is not null").select("src", "dst").distinct().join(ids.withColumnRenamed("node", "src"), "src", "left_semi"), "edges")
    needed = materialize(live.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("needed")).join(ids, "node", "left_semi"), "needed")
    path, schema = fresh_path(spark, "levels"), T.StructType([*ids.schema.fields, T.StructField("level", T.IntegerType())])
    write = lambda free, k: free.select("node").write.parquet(f"{path}/level={k}")
    read = lambda k: spark.read.schema(ids.schema).parquet(f"{path}/level={k}")
    write(ids.join(needed, "node", "left_anti"), 0)
    half, k = None, 0
    while read(k).limit(1).count():
        met = live.join(read(k).withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("met"))
        met = met if half is None else met.union(half).groupBy("node").agg(F.sum("met").alias("met"))
        counted = materialize(met.join(needed, "node"), "counted")
        k += 1
        write(counted.where("met = needed"), k)
        older, half = half, counted.where("met < needed").select("node", "met")
        half._written_to = counted._written_to
        if older is not None:
            discard(older)
    discard(live, needed, *([half] if half is not None else []))
    done = spark.read.schema(schema).parquet(path)
    rest = nodes.select("node").distinct().join(done.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti")
    return done.unionByName(rest.withColumn("level", F.when(F.col("node").isNull(), 0)))  # nothing leads to a null node


def propagate(assets: DataFrame, edges: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """node, risk, effective: R_eff = 1 - (1 - R) * product over parents (1 - gamma * weight * R_eff(parent)), level by level, rounded to 6.
    assets: node, risk; edges: src, dst, weight. Raises on a cycle.

    Nodes lie by their level and edges by their source's. A level reads what was sent to it, its own nodes and their edges, and sends factors on to the levels of its
    edges' targets: every node, edge and factor is written and read once, however deep the graph."""
    spark = assets.sparkSession
    assets, edges = materialize(assets, "assets"), materialize(edges.select("src", "dst", "weight"), "asset_edges")  # each is read several times
    lv = materialize(levels(assets, edges), "node_levels")
    if lv.where("level is null and node is not null").limit(1).count():
        raise ValueError("the asset graph has a cycle")
    top = lv.agg(F.max("level")).first()[0] or 0
    folder = fresh_path(spark, "lineage")
    by_level = lambda df, name, level: df.write.partitionBy(level).parquet(f"{folder}/{name}")
    by_level(assets.join(lv.where("level is not null"), "node").select("node", "risk", "level"), "nodes", "level")
    known = lv.where("level is not null and node is not null")
    ends = edges.join(known.select(F.col("node").alias("src"), F.col("level").alias("from")), "src").join(known.select(F.col("node").alias("dst"), F.col("level").alias("to")), "dst")
    by_level(ends.select("src", "dst", F.col("weight").cast("double").alias("weight"), "from", "to"), "edges", "from")
    node_type = assets.schema["node"].dataType
    nodes = spark.read.schema(T.StructType([T.StructField("node", node_type), assets.schema["risk"], T.StructField("level", T.IntegerType())])).parquet(f"{folder}/nodes")
    out_edges = spark.read.schema(T.StructType([T.StructField("src", node_type), T.StructField("dst", node_type), T.StructField("weight", T.DoubleType()), T.StructField("to", T.IntegerType()), T.StructField("from", T.IntegerType())])).parquet(f"{folder}/edges")
    sent = T.StructType([T.StructField("node", node_type), T.StructField("f", T.DoubleType()), T.StructField("to", T.IntegerType())])
    result = T.StructType([T.StructField("node", node_type), assets.schema["risk"], T.StructField("effective", T.DoubleType())])
    for k in range(top + 1):
        own = nodes.where(F.col("level") == k).drop("level")
        if k == 0:
            own = own.withColumn("effective", round6(F.col("risk")))
        else:
            factors = spark.read.schema(sent).parquet(f"{folder}/sent").where(F.col("to") == k).groupBy("node").agg(F.product("f").alias("f"))
            own = own.join(factors, "node", "left").select("node", "risk", round6(clamp(1 - (1 - F.col("risk")) * F.coalesce("f", F.lit(1.0)))).alias("effective"))
        own.write.parquet(f"{folder}/done/at={k}")
        if k < top:
            now = spark.read.schema(result).parquet(f"{folder}/done/at={k}")
            factor = 1 - clamp(gamma * F.col("weight") * F.col("effective"))
            on = out_edges.where(F.col("from") == k).join(now.select(F.col("node").alias("src"), "effective"), "src").select(F.col("dst").alias("node"), factor.alias("f"), "to")
            on.write.mode("append").partitionBy("to").parquet(f"{folder}/sent")
    return spark.read.schema(T.StructType([*result.fields, T.StructField("at", T.IntegerType())])).parquet(f"{folder}/done").drop("at")


def chain_paths(assets: DataFrame, edges: DataFrame, depth: int = DEPTH, gamma: float = GAMMA) -> DataFrame:
    """path (array of 2 to depth nodes, none twice), hops, score = 1 - product over hops (1 - gamma * R * R')."""
    r = assets.select("node", "effective")
    hop = edges.select("src", "dst").distinct().join(r.select(F.col("node").alias("src"), F.col("effective").alias("rs")), "src").join(r.select(F.col("node").alias("dst"), F.col("effective").alias("rd")), "dst")
    hop = hop.select("src", "dst", clamp(gamma * F.col("rs") * F.col("rd")).alias("h"))
    at = hop.select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"), (1 - F.col("h")).alias("keep"))
    out = at
    for _ in range(depth - 2):
        at = at.join(hop.withColumnRenamed("src", "end"), "end").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"), (F.col("keep") * (1 - F.col("h"))).alias("keep"))
        out = out.union(at)
    return out.select("path", (F.size("path") - 1).alias("hops"), round6(clamp(1 - F.col("keep"))).alias("score"))


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """start, node of everything upstream of the start nodes: rounds go on until one finds nothing new."""
    seen = materialize(start.select(F.col("node").alias("start"), "node"), "seen")
    frontier = seen
    while True:
        step = frontier.join(edges.select(F.col("dst").alias("node"), "src"), "node").select("start", F.col("src").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        frontier = materialize(step, "frontier")
        if not frontier.limit(1).count():
            break
        seen = materialize(seen.union(frontier), "seen")
    return seen.where("start <> node")


def project_risk(assets: DataFrame, alpha: float = PEAK, inter: float = INTER, roles: dict[str, float] = ROLES) -> DataFrame:
    """project_id, risk, level, peak, peak_asset, n_assets: 1 - (1 - max)^alpha * product(1 - inter * role * R). assets: project_id, asset_id,
    risk, role."""
    w = F.coalesce(F.try_element_at(_map(roles), F.col("role")), F.lit(1.0))
    g = assets.groupBy("project_id").agg(F.max(F.struct("risk", "asset_id")).alias("x"), F.product(1 - clamp(inter * w * F.col("risk"))).alias("f"), F.count("*").alias("n_assets"))
    out = g.select("project_id", round6(clamp(1 - F.pow(1 - F.col("x.risk"), F.lit(alpha)) * F.col("f"))).alias("risk"), round6(F.col("x.risk")).alias("peak"), F.col("x.asset_id").alias("peak_asset"), "n_assets")
    return out.withColumn("level", risk_level(F.col("risk")))


def band(score: Column, bands: Sequence[tuple[float, str]] = BANDS) -> Column:
    """The decision of a score: half-open bands by their upper end; REJECT beyond them and for null."""
    out = F.when(score < bands[0][0], bands[0][1])
    for upper, decision in bands[1:]:
        out = out.when(score < upper, decision)
    return out.otherwise("REJECT")


def decision_rank(decision: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in DECISIONS)), decision).cast("int")


def condition(field: str, op: str, value: object, kind: str) -> Column:
    """One condition on a column. kind: the column's type. Missing numbers are 0 for orderings; doubles are equal at 6 places."""
    x, number = F.col(field), kind in ("double", "float", "int", "bigint")
    if op in ("EQUALS", "NOT_EQUALS"):
        same = F.round(x, 6) == F.round(F.lit(float(value)), 6) if kind in ("double", "float") and isinstance(value, (int, float)) else x == F.lit(value)
        same = F.coalesce(same, F.lit(False))
        return same if op == "EQUALS" else ~same
    orderings = {"GREATER_THAN": "__gt__", "GREATER_EQUAL": "__ge__", "LESS_THAN": "__lt__", "LESS_EQUAL": "__le__"}
    if op in orderings:
        left = F.when(x.isNull(), F.lit(0.0)).otherwise(x.cast("double") if number else x.try_cast("double"))
        return F.coalesce(getattr(left, orderings[op])(F.lit(float(value))), F.lit(False))
    if op == "IN":
        return F.coalesce(x.isin(list(value)), F.lit(False))
    if op == "CONTAINS":
        return F.coalesce(F.array_contains(x, value) if kind.startswith("array") else F.contains(x, F.lit(value)), F.lit(False))
    raise ValueError(f"unknown operator {op}")


def apply_policy(assets: DataFrame, rules: Sequence[dict], score: str = "risk", bands: Sequence[tuple[float, str]] = BANDS) -> DataFrame:
    """assets with baseline, matched (rule ids by priority), decision, rule (what escalated). Rules only escalate. A rule: id, priority, decision,
    conditions (field, op, value)."""
    kinds = dict(assets.dtypes)
    out = assets.withColumn("baseline", band(F.col(score), bands))
    hits = []
    for r in sorted((r for r in rules if r.get("enabled", True)), key=lambda r: (r["priority"], r["id"])):
        met = F.lit(True)
        for c in r["conditions"]:
            met = met & condition(c[0], c[1], c[2], kinds[c[0]])
        hits.append(F.when(met, F.struct(F.lit(r["id"]).alias("id"), F.lit(DECISIONS.index(r["decision"]) + 1).alias("rank"))))
    matched = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<struct<id:string,rank:int>>")
    out = out.withColumn("__m", matched).withColumn("__b", decision_rank(F.col("baseline")))
    top = F.coalesce(F.array_max(F.transform("__m", lambda m: m["rank"])), F.lit(0))
    out = out.withColumn("__t", top).withColumn("decision", F.when(F.col("__t") > F.col("__b"), F.element_at(F.array(*(F.lit(x) for x in DECISIONS)), F.greatest(F.col("__t"), F.lit(1)))).otherwise(F.col("baseline")))
    first = F.element_at(F.filter("__m", lambda m: m["rank"] == F.col("__t")), 1)["id"]
    return out.withColumn("matched", F.transform("__m", lambda m: m["id"])).withColumn("rule", F.when(F.col("__t") > F.col("__b"), first)).drop("__m", "__b", "__t")


def disposition(projects: DataFrame, assets: DataFrame) -> DataFrame:
    """project_id, decision: the project's band, REJECT if a core asset's proof failed, at least QUARANTINE if a peripheral one's did."""
    bad = assets.where("proof_failed").groupBy("project_id").agg(F.max(F.col("role") == "CORE_DEPLOYED").alias("core"), F.max(F.col("role") == "PERIPHERAL_SAMPLE").alias("edge"))
    p = projects.join(bad, "project_id", "left").withColumn("baseline", band(F.col("risk")))
    decision = F.when(F.coalesce("core", F.lit(False)), "REJECT").when(F.coalesce("edge", F.lit(False)) & F.col("baseline").isin("ACCEPT", "REVIEW"), "QUARANTINE").otherwise(F.col("baseline"))
    return p.select("project_id", "risk", "baseline", decision.alias("decision"), F.coalesce(F.col("core") | F.col("edge"), F.lit(False)).alias("proof_override"))


def fuse(evidence: DataFrame, category_weights: dict[str, float], damping: float = 0.10, other: float = 0.5, review: float = 0.30, quarantine: float = 0.65) -> DataFrame:
    """Assurance fusion: project_id, risk, level, disposition, n_clusters. Clusters are (asset, category); a failed proof decides alone."""
    w = F.coalesce(F.try_element_at(_map(category_weights), F.col("domain")), F.lit(other)) * severity_weight(F.col("severity"), SEVERITY_BY_CLASS, 0.5)
    e = evidence.withColumn("term", w * F.coalesce("confidence", F.lit(0.9)))
    c = e.groupBy("project_id", "asset_id", "domain").agg(F.max("term").alias("m"), F.sum("term").alias("s"))
    g = c.groupBy("project_id").agg(clamp(noisy_or(clamp(F.col("m") + damping * (F.col("s") - F.col("m"))))).alias("risk"), F.count("*").alias("n_clusters"))
    broken = evidence.where((F.col("layer") == "PROOF") & F.lower("severity").isin("critical", "high")).select("project_id").distinct().withColumn("broken", F.lit(True))
    out = g.join(broken, "project_id", "left")
    level = F.when(F.col("risk") >= 0.85, "CRITICAL").when(F.col("risk") >= 0.65, "HIGH").when(F.col("risk") >= 0.30, "MEDIUM").otherwise("LOW")
    state = F.when(F.col("broken"), "QUARANTINE").when(F.col("risk") < review, "ACCEPT").when(F.col("risk") < quarantine, "REVIEW").otherwise("QUARANTINE")
    return out.select("project_id", round6(F.col("risk")).alias("risk"), level.alias("level"), state.alias("disposition"), "n_clusters")


def compliance(controls: Sequence[dict], evidence: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, control_id, status. A control: id, domains, layers, most_risk, proof. projects: project_id, risk (greatest of an asset),
    proof_failed."""
    spark = evidence.sparkSession
    rows = spark.createDataFrame([(c["id"], list(c["domains"]), list(c["layers"]), float(c["most_risk"]), bool(c["proof"])) for c in controls], "control_id string, domains array<string>, layers array<string>, most_risk double, proof boolean")
    wanted = rows.select("control_id", F.explode("domains").alias("domain"))
    seen = evidence.groupBy("project_id", "domain", "layer").agg(F.count("*").alias("n"))
    have = seen.join(F.broadcast(wanted), "domain").groupBy("project_id", "control_id").agg(F.sum("n").alias("n"), F.collect_set("layer").alias("found"))
    every = projects.crossJoin(F.broadcast(rows))  # a list of controls
    out = every.join(have, ["project_id", "control_id"], "left")
    met = F.when(F.size(F.array_except("layers", F.coalesce("found", F.array().cast("array<string>")))) > 0, "PARTIALLY_COMPLIANT").otherwise("COMPLIANT")
    status = F.when(F.col("n").isNull(), "UNAVAILABLE").when(F.col("proof_failed") & F.col("proof"), "NON_COMPLIANT").when(F.col("risk") > F.col("most_risk"), F.when(F.col("risk") >= 0.70, "NON_COMPLIANT").otherwise("PARTIALLY_COMPLIANT")).otherwise(met)
    return out.select("project_id", "control_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_evidence"))


def report_diff(base: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (ADDED, REMOVED, CHANGED), before, after of what differs."""
    j = base.select(F.col(key).alias("k"), F.col(value).alias("before"), F.lit(True).alias("b")).join(target.select(F.col(key).alias("k"), F.col(value).alias("after"), F.lit(True).alias("t")), "k", "full_outer")
    change = F.when(F.col("b").isNull(), "ADDED").when(F.col("t").isNull(), "REMOVED").when(~F.col("before").eqNullSafe(F.col("after")), "CHANGED")
    return j.select(F.col("k").alias(key), change.alias("change"), "before", "after").where("change is not null")


def page(findings: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50, **equal: object) -> DataFrame:
    """A page of a catalogue list: filters first, then the order, then offset and limit (1 to 500), so that pages are full."""
    for c, v in equal.items():
        if v is not None:
            findings = findings.where(F.col(c) == v)
    return findings.orderBy(*order).offset(offset).limit(min(max(limit, 1), 500))


def latest_version(versions: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the greatest order."""
    others = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("x")).select(key, "x.*")


def window_rank(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))
