"""Queries of catalogue lookups, proof and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..functions.shared import fresh_path, materialize, on_store
from ..operators import catalogue, risk
from ..sources import datasets, models, reports
from .assurance_queries import _BAND, _EVID, _MILD, _evidence, _mild


def evidence_findings_join(spark, d):
    """Orders as findings, their line items as evidence, customers' nations as projects."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("project_id"), F.col("o_orderkey").alias("finding_id"), F.col("o_orderstatus").alias("disposition"))
    e = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") % 25).alias("project_id"), F.col("l_orderkey").alias("finding_id"), F.col("l_quantity").alias("weight"))
    return catalogue.evidence_of_findings(o, e).groupBy("project_id", "disposition").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def sample_version_join(spark, d):
    """Line items as samples, orders as versions, customers as datasets of four projects each."""
    s = table(spark, d, "lineitem").select((F.col("l_orderkey") % 4).alias("project_id"), (F.col("l_orderkey") / 4).cast("long").alias("version_id"), "l_quantity")
    v = table(spark, d, "orders").select((F.col("o_orderkey") % 4).alias("project_id"), (F.col("o_orderkey") / 4).cast("long").alias("version_id"), F.col("o_custkey").alias("dataset_id"))
    c = table(spark, d, "customer").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("project_id"), F.col("c_custkey").alias("dataset_id"), "c_mktsegment")
    return catalogue.samples_of_datasets(s, v, c).groupBy("project_id", "c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("dataset_id").alias("n_datasets"))


def semi_join_ids(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("l_orderkey"))
    return catalogue.of_ids(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), big, "l_orderkey")


def traceability(spark, d):
    """Orders with their least line as primary evidence, all lines as referenced, parts as assets and records. Evidence and assets have the same ids in all five projects, and are others in each."""
    k, p = F.col("l_partkey") % 500, F.col("l_suppkey") % 5
    e = table(spark, d, "lineitem").select(p.alias("project_id"), F.concat(F.lit("e"), k).alias("evidence_id"), F.concat(F.lit("a"), (k * 7 + p) % 100).alias("asset_id"), F.col("l_orderkey").alias("finding_id"))
    known = materialize(e.select("project_id", "evidence_id", "asset_id").distinct(), "evidence")
    f = e.groupBy("project_id", "finding_id").agg(F.min("evidence_id").alias("evidence_id")).join(catalogue.counted(known), ["project_id", "evidence_id"])
    r = table(spark, d, "part").select((F.col("p_partkey") % 5).alias("project_id"), F.concat(F.lit("a"), F.col("p_partkey") % 100).alias("asset_id"), F.concat(F.lit("r"), F.col("p_size")).alias("record_id")).distinct()
    out = catalogue.traceability(f, known, e.select("project_id", "finding_id", "evidence_id"), r)
    return out.groupBy("project_id", "finding_id", "kind").agg(F.count("*").alias("n"), F.min("ref").alias("least"), F.max("ref").alias("greatest"))


def finding_evidence_lookup(spark, d):
    """The finding's evidence and the evidence's findings, over edges that many findings share; ids repeat in other projects."""
    k, p = F.col("l_partkey") % 500, F.col("l_suppkey") % 5
    i = table(spark, d, "lineitem")
    edges = i.select(p.alias("project_id"), F.concat(F.lit("f"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("e"), k).alias("dst"), F.when(F.col("l_linenumber") == 1, "PRIMARY").when(F.col("l_linenumber") < 4, "SUPPORTS").otherwise("MENTIONS").alias("kind")).distinct()
    nodes = edges.select("project_id", F.col("src").alias("node"), F.lit("FINDING").alias("type")).union(edges.select("project_id", "dst", F.lit("EVIDENCE"))).distinct()
    out = catalogue.neighbours(nodes, edges, ["PRIMARY", "SUPPORTS"]).union(catalogue.neighbours(nodes, edges, ["PRIMARY", "SUPPORTS"], outgoing=False))
    return out.groupBy("project_id", "node", "kind", "other_type").agg(F.count("*").alias("n"), F.min("other").alias("least"))


def lookup_by_primary_key(spark, d):
    return catalogue.by_key(table(spark, d, "orders"), {"o_orderkey": 7}).select("o_orderkey", "o_custkey", "o_orderstatus")


def lookup_by_alternate_key(spark, d):
    return catalogue.by_key(table(spark, d, "lineitem"), {"l_partkey": 17, "l_returnflag": "N"}).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def proof_status(spark, d):
    e = _evidence(spark, d)
    k = F.regexp_extract("asset_id", r"\d+", 0).cast("long")
    p = e.select("project_id", "asset_id").distinct().where(k % 3 != 0).withColumn("valid", k % 5 != 1)
    return catalogue.proof_status(e, p)


def evidence_cube(spark, d):
    return catalogue.summary(_evidence(spark, d), ["layer", "severity"], F.lit(1).cast("long"))


def sample_fingerprints(spark, d):
    docs = table(spark, d, "documents")
    return catalogue.fingerprints(docs, F.col("text"), [F.col("lang"), F.col("source")]).select("doc_id", "fingerprint")


def redacted_records(spark, d):
    """Events as nested records with keys, tokens and passwords in structs, arrays, maps and texts."""
    k = F.col("event_id")
    e = table(spark, d, "events").select(
        "event_id", F.struct(F.concat(F.lit("k"), "user_id").alias("api_key"), F.col("event_type").alias("name")).alias("account"), F.array(F.struct(k.alias("Token"), (k % 7).alias("n"))).alias("calls"),
        F.create_map(F.lit("Password"), F.col("event_type"), F.lit("kind"), F.col("event_type")).alias("fields"), F.when(k % 5 == 0, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----"), k)).otherwise(F.col("props")).alias("note"),
    )
    return reports.redacted(e).select("event_id", F.col("account.api_key").alias("api_key"), F.col("account.name").alias("name"), F.col("calls")[0]["Token"].alias("token"), F.col("calls")[0]["n"].alias("n"), F.col("fields")["Password"].alias("password"), F.col("fields")["kind"].alias("kind"), "note")


def audit_report(spark, d):
    """Evidence, damped asset risks and their bands as a report for each project; maps as texts."""
    e, a = _evidence(spark, d), _mild(spark, d).select("project_id", "asset_id", "risk")
    out = reports.audit_report(e, a, e.where("layer = 'DETECTION'").select("project_id", "severity"), a.withColumn("decision", risk.band(F.col("risk"))))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias(c)
    return out.select(*(text(c) if c in ("domains", "findings", "n_by_decision") else c for c in out.columns if c != "content_hash"))


def coco_scan(spark, d):
    """Parts as images and their line items as annotations, written as COCO documents of 500 parts each, and read back by blocks."""
    group = (F.col("p_partkey") / 500).cast("long")
    p = table(spark, d, "part")
    i = table(spark, d, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("category_id")), "l_partkey")
    q = F.col("l_quantity").cast("double")
    note = F.struct(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("image_id"), "category_id", F.array(F.lit(0.0), F.lit(1.0), q, q + 1).alias("bbox"), (q * (q + 1)).alias("area"),
        (F.col("l_linenumber") % 2).alias("iscrowd"), F.array(F.array(F.lit(0.0), F.lit(0.0), q, F.lit(0.0), q, q)).alias("segmentation"), F.concat(F.lit("}"), "l_returnflag").alias("mode"),
    )
    images = p.groupBy(group.alias("g")).agg(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.concat(F.lit("img/"), F.col("p_partkey"), F.lit(".png")).alias("file_name"), F.lit(8).alias("width"), F.lit(8).alias("height"))).alias("images"))
    notes = i.groupBy((F.col("l_partkey") / 500).cast("long").alias("g")).agg(F.collect_list(note).alias("annotations"))
    kinds = F.when(F.col("g") == 0, F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: F.struct(k.alias("id"), F.concat(F.lit("size "), k).alias("name")))).alias("categories")
    folder = fresh_path(spark, "coco")
    images.join(notes, "g", "left").select(F.to_json(F.struct("images", "annotations", kinds)).alias("value")).write.text(folder)
    _, found, faults = datasets.read_coco(spark, folder)
    out = found.groupBy("category_name", "is_crowd", F.col("attributes")["mode"].alias("mode")).agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("n_samples"), F.sum("area").cast("long").alias("area"), F.max(F.length("segmentation")).cast("long").alias("longest"))
    bad = faults.groupBy(F.col("code").alias("category_name")).agg(F.count("*").alias("n"))
    return out.unionByName(bad, allowMissingColumns=True)


def _model_files(tensors, folder, limit=16 << 20):
    """path, size of safetensors files of `limit` bytes or one tensor (name, data), written by the tasks; files of attempts that failed aren't listed."""
    import json
    import struct
    import uuid

    import pyarrow as pa

    def made(held):
        table, at = {}, 0
        for name, data in held:
            table[name] = {"dtype": "U8", "shape": [len(data)], "data_offsets": [at, at := at + len(data)]}
        head, path = json.dumps(table).encode(), f"{folder}/{uuid.uuid4().hex}.safetensors"
        with models.create_path(path) as f:
            f.write(struct.pack("<Q", len(head)) + head)
            for _, data in held:
                f.write(data)
        return pa.RecordBatch.from_pydict({"path": [path], "size": [8 + len(head) + at]})

    def run(batches):
        held, n = {}, 0
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name in held or n + len(data) > limit and held:
                    yield made([*held.items()])
                    held, n = {}, 0
                held[name] = data
                n += len(data)
        if held:
            yield made([*held.items()])

    return materialize(tensors.select("name", "data").mapInArrow(run, "path string, size long"), "model_files")


def model_scan(spark, d):
    """All texts as tensors of bytes in safetensors files, found by their headers and hashed by ranges."""
    folder = fresh_path(spark, "models")
    fs, path = on_store(spark, folder)
    fs.mkdirs(path)
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    found = models.scan_ranges(_model_files(texts, folder))
    return found.select(F.col("name").cast("long").alias("doc_id"), "format", "dtype", F.get("shape", F.lit(0)).alias("length"), "byte_length", "content_hash", "status")


QUERIES = {
    "model_scan": model_scan, "coco_scan": coco_scan, "evidence_findings_join": evidence_findings_join, "sample_version_join": sample_version_join, "semi_join_ids": semi_join_ids, "traceability": traceability, "finding_evidence_lookup": finding_evidence_lookup, "lookup_by_primary_key": lookup_by_primary_key, "lookup_by_alternate_key": lookup_by_alternate_key, "proof_status": proof_status,
    "evidence_cube": evidence_cube, "sample_fingerprints": sample_fingerprints, "redacted_records": redacted_records, "audit_report": audit_report,
}

SQL = {
    "model_scan": """SELECT doc_id, 'safetensors' AS format, 'U8' AS dtype, octet_length(encode(coalesce(text, '')))::BIGINT AS length, octet_length(encode(coalesce(text, '')))::BIGINT AS byte_length, sha256(coalesce(text, '')) AS content_hash, 'VALID' AS status FROM documents""",
    "coco_scan": """SELECT 'size ' || p_size AS category_name, l_linenumber % 2 = 1 AS is_crowd, '}' || l_returnflag AS mode, count(*) AS n, count(DISTINCT l_partkey) AS n_samples, sum(l_quantity * (l_quantity + 1))::BIGINT AS area,
  max(length('[[0.0,0.0,' || l_quantity::DOUBLE || ',0.0,' || l_quantity::DOUBLE || ',' || l_quantity::DOUBLE || ']]')) AS longest FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL
UNION ALL SELECT 'DUPLICATE_ANNOTATION', NULL, NULL, count(*), NULL, NULL, NULL FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0""",
    "evidence_findings_join": "SELECT o_custkey % 25 AS project_id, o_orderstatus AS disposition, count(*) AS n, sum(l_quantity) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "sample_version_join": "SELECT o_orderkey % 4 AS project_id, c_mktsegment, count(*) AS n, count(DISTINCT c_custkey) AS n_datasets FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2",
    "semi_join_ids": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)",
    "traceability": """WITH e AS (SELECT l_suppkey % 5 AS p, 'e' || (l_partkey % 500) AS eid, 'a' || (((l_partkey % 500) * 7 + l_suppkey % 5) % 100) AS aid, l_orderkey AS fid FROM lineitem), r AS (SELECT DISTINCT p_partkey % 5 AS p, 'a' || (p_partkey % 100) AS aid, 'r' || p_size AS rid FROM part),
x AS (SELECT p, fid, 'PRIMARY' AS kind, min(eid) AS ref FROM e GROUP BY p, fid UNION SELECT p, fid, 'REFERENCED', eid FROM e UNION SELECT p, fid, 'ASSET', aid FROM e UNION SELECT p, fid, 'PROVENANCE', rid FROM e JOIN r USING (p, aid))
SELECT p AS project_id, fid AS finding_id, kind, count(*) AS n, min(ref) AS least, max(ref) AS greatest FROM x GROUP BY ALL""",
    "finding_evidence_lookup": """WITH e AS (SELECT DISTINCT l_suppkey % 5 AS p, 'f' || l_orderkey AS f, 'e' || (l_partkey % 500) AS e, CASE WHEN l_linenumber = 1 THEN 'PRIMARY' WHEN l_linenumber < 4 THEN 'SUPPORTS' ELSE 'MENTIONS' END AS kind FROM lineitem)
SELECT p AS project_id, f AS node, kind, 'EVIDENCE' AS other_type, count(*) AS n, min(e) AS least FROM e WHERE kind <> 'MENTIONS' GROUP BY ALL UNION ALL SELECT p, e, kind, 'FINDING', count(*), min(f) FROM e WHERE kind <> 'MENTIONS' GROUP BY ALL""",
    "lookup_by_primary_key": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "lookup_by_alternate_key": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 17 AND l_returnflag = 'N'",
    "proof_status": f"""WITH {_EVID}, x AS (SELECT project_id, asset_id, count(*) AS n, asset_id[2:]::INTEGER AS k FROM e WHERE layer = 'PROOF' GROUP BY ALL)
SELECT project_id, asset_id, n, CASE WHEN k % 3 = 0 THEN 'MISSING' WHEN k % 5 = 1 THEN 'INVALID' ELSE 'VERIFIED' END AS status, k % 3 = 0 OR k % 5 = 1 AS fatal FROM x""",
    "evidence_cube": f"WITH {_EVID} SELECT layer, severity, grouping_id(layer, severity)::BIGINT AS grouping, count(*) AS n, count(*) AS total FROM e GROUP BY CUBE (layer, severity)",
    "sample_fingerprints": "SELECT doc_id, sha256(sha256(text) || '|' || array_to_string(list_sort([sha256(lang), sha256(source)]), '|')) AS fingerprint FROM documents",
    "redacted_records": """SELECT event_id, '[REDACTED_SECRET:sha256_' || sha256('k' || user_id)[1:12] || ']' AS api_key, event_type AS name, '[REDACTED_SECRET:sha256_' || sha256(event_id::VARCHAR)[1:12] || ']' AS token, event_id % 7 AS n, '[REDACTED_SECRET:sha256_' || sha256(event_type)[1:12] || ']' AS password, event_type AS kind,
  CASE WHEN event_id % 5 = 0 THEN '[REDACTED_SECRET:sha256_' || sha256('-----BEGIN RSA PRIVATE KEY-----' || event_id)[1:12] || ']' ELSE props END AS note FROM events""",
    "audit_report": f"""WITH {_MILD}, dc AS (SELECT *, {_BAND.format('risk')} AS decision FROM am), a AS (SELECT project_id, count(*) AS n_assets, max(risk) AS peak_risk, arg_min(asset_id, {{'r': -risk, 'a': asset_id}}) AS peak_asset_id, (['ACCEPT', 'REVIEW', 'QUARANTINE', 'REJECT'])[max(list_position(['ACCEPT', 'REVIEW', 'QUARANTINE', 'REJECT'], decision))] AS decision FROM dc GROUP BY 1),
f AS (SELECT project_id, count(*) AS n_evidence, count(*) FILTER (layer = 'DETECTION') AS n_detection, count(*) FILTER (layer = 'PROOF') AS n_proof, 0::BIGINT AS n_policy FROM e GROUP BY 1), k AS (SELECT project_id, 'd' AS m, domain AS k, count(*) AS v FROM e GROUP BY ALL UNION ALL SELECT project_id, 'f', severity, count(*) FROM e WHERE layer = 'DETECTION' GROUP BY ALL UNION ALL SELECT project_id, 'n', decision, count(*) FROM dc GROUP BY ALL),
t AS (SELECT project_id, string_agg(k || '=' || v, ';' ORDER BY k) FILTER (m = 'd') AS domains, string_agg(k || '=' || v, ';' ORDER BY k) FILTER (m = 'f') AS findings, string_agg(k || '=' || v, ';' ORDER BY k) FILTER (m = 'n') AS n_by_decision FROM k GROUP BY 1)
SELECT * FROM a JOIN f USING (project_id) JOIN t USING (project_id)""",
}
