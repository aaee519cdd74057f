"""Queries of streams, images, model inputs and outputs, texts, and the mutation lab."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import table
from ..functions.shared import fresh_path, materialize
from ..functions import text
from ..operators import drift, images, inference, mutations
from ..sources import catalog_sink
from ..streaming import streams


def _stream(spark, d):
    """The pattern lets a stream take one file as well as a folder of files."""
    return streams.event_time(streams.read_stream(spark, f"{d}/event[s].parquet"), "ts", "1 day")


def _plain(df, *times):
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c in times else F.round(c, 4).alias(c) if c == "total" else c for c in df.columns))


def stream_tumbling(spark, d):
    return _plain(streams.run_available(streams.tumbling(_stream(spark, d), "ts", "1 day", ["event_type"], "value"), "complete"), "start")


def stream_sliding(spark, d):
    return _plain(streams.run_available(streams.sliding(_stream(spark, d), "ts", "2 days", "1 day", ["event_type"], "value"), "complete"), "start")


def stream_sessions(spark, d):
    return _plain(streams.run_available(streams.sessions(_stream(spark, d), "ts", "6 hours", ["user_id"]), "complete"), "start", "end")


def stream_dedupe(spark, d):
    return streams.run_available(streams.deduplicate(_stream(spark, d), ["user_id", "event_type"]).select("user_id", "event_type"), "append")


def stream_replay_state(spark, d):
    s = _stream(spark, d).select("user_id", F.when(F.col("event_id") % 97 != 9, F.col("event_id")).alias("event_id"), F.floor("value").cast("string").alias("nonce"))
    return streams.run_available(streams.sequence_check(s, "user_id", "event_id", "nonce"), "update", ["user_id"])


def stream_late_rows(spark, d):
    """Events that arrive in four deliveries, some without a time, some with none that can be read, some three days late: accepted rows by type and dead rows by reason."""
    e = table(spark, d, "events")
    n, k, time = e.count(), F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    raw = F.when(k % 50 == 3, F.lit(None)).when(k % 50 == 5, " ").when(k % 50 == 7, "yesterday").when(k % 50 == 11, F.date_format(F.col("ts") - F.expr("INTERVAL 3 DAYS"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(time)
    folder, files = fresh_path(spark, "deliveries"), 8
    sent = e.select("event_id", "event_type", raw.alias("observed_at"))
    for part in range(4):  # a delivery has as many files as a batch takes
        sent.where(F.floor(k * 4 / n) == part).repartition(files).write.mode("append").parquet(folder)
    accepted, dead, _ = streams.run_accounted(streams.read_stream(spark, folder, files), "observed_at", F.try_to_timestamp("observed_at", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), 86_400)
    count = [F.count("*").alias("n"), F.sum("event_id").alias("ids")]
    return accepted.groupBy("event_type").agg(*count).withColumn("reason", F.lit(None).cast("string")).unionByName(dead.groupBy("event_type", "reason").agg(*count))


def catalog_ingest(spark, d):
    """Documents and their sources written together to a catalogue, half of them first, then all, then all again: what a reader finds."""
    root, docs = fresh_path(spark, "catalogue"), table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    for part in (docs.where("doc_id % 2 = 0"), docs, docs):
        catalog_sink.write(root, {"documents": (part, "doc_id"), "sources": (part.groupBy("source", "lang").agg(F.min("doc_id").alias("first_id")).select("first_id", "source", "lang"), "first_id")})
    gapless = (F.countDistinct("sequence") == F.count("*")) & (F.max("sequence") == F.count("*") - 1) & (F.min("sequence") == 0)
    shown = [F.count("*").alias("n"), F.countDistinct("content_hash").alias("n_contents"), gapless.alias("gapless")]
    return catalog_sink.read(spark, root, "documents").agg(*shown).withColumn("name", F.lit("documents")).unionByName(catalog_sink.read(spark, root, "sources").agg(*shown).withColumn("name", F.lit("sources")))


#: So many pictures that a task which perturbs them takes seconds.
IMAGES_A_TASK = 1024


def _drawn(keys):
    """A 32 x 32 picture for each p_partkey k: pixel = (x * (k % 7 + 1) + y * (k % 5 + 1) + 40 * channel + k) % 256."""

    def draw(batches):
        y, x, c = np.mgrid[:32, :32, :3]
        for pdf in batches:
            made = [((x * (k % 7 + 1) + y * (k % 5 + 1) + 40 * c + k) % 256).astype(np.uint8).tobytes() for k in pdf["p_partkey"]]
            yield pd.DataFrame({"image_id": pdf["p_partkey"], "height": 32, "width": 32, "channels": 3, "pixels": made})

    return keys.mapInPandas(draw, f"image_id long, {images.SCHEMA}")


def _images(spark, d):
    """A picture for each part."""
    return _drawn(table(spark, d, "part").select("p_partkey"))


def _rounded(df, places=6):
    return df.select(*(F.round(c, places).alias(c) if t == "double" else c for c, t in df.dtypes))


def image_descriptors(spark, d):
    return _rounded(images.image_descriptors(_images(spark, d)))


def image_quality(spark, d):
    return _rounded(images.image_quality(_images(spark, d)))


def image_findings(spark, d):
    blurred = images.transform(_images(spark, d), lambda a, s: images.blur(a, 4.0) if s % 2 else a)
    return images.quality_findings(images.image_quality(blurred))


def image_hashes(spark, d):
    return images.perceptual_hashes(_images(spark, d))


def image_drift(spark, d):
    """Descriptors of the pictures against those of their brightened copies."""
    names = ["mean_intensity", "std_intensity", "entropy", "r_mean", "mean_saturation"]
    a = images.image_descriptors(_images(spark, d)).withColumn("t", F.lit(False))
    b = images.image_descriptors(images.perturbed(_images(spark, d), "brightness")).withColumn("t", F.lit(True))
    out = drift.features(drift.melt(a.union(b), F.col("t"), names))
    return out.select("feature", F.round("ks", 6).alias("ks"), F.round("psi", 6).alias("psi"), "status")


def perturbation_sensitivity(spark, d):
    """How far each perturbation moves the pixels and the visual vector. A picture is drawn once and meets all perturbations."""
    keys = table(spark, d, "part").select("p_partkey")
    base = _drawn(keys.repartition(max(1, -(-keys.count() // IMAGES_A_TASK))))  # a small file of keys is many pictures
    names = [f"{of}_{name}" for name in images.PERTURBATIONS for of in ("input_rmse", "output_l2")]

    def moved(a: np.ndarray) -> dict:
        out, plain, vector = {}, a.astype(float), images.visual_vector(a)
        for name in images.PERTURBATIONS:
            b = images.perturb(a, name, 7)
            out[f"input_rmse_{name}"] = float(np.sqrt(np.mean((plain - b) ** 2)))
            out[f"output_l2_{name}"] = float(np.linalg.norm(np.subtract(vector, images.visual_vector(b))))
        return out

    m = images.measure(base, moved, names).agg(*(F.avg(n).alias(n) for n in names))
    out = m.select(F.explode(F.array(*(F.struct(F.lit(name).alias("perturbation"), *(F.col(f"{of}_{name}").alias(of) for of in ("input_rmse", "output_l2"))) for name in images.PERTURBATIONS))).alias("x")).select("x.*")
    ratio, status = inference.sensitivity(F.col("output_l2"), F.col("input_rmse"))
    return out.select("perturbation", F.round("input_rmse", 4).alias("input_rmse"), F.round("output_l2", 6).alias("output_l2"), F.round(ratio, 6).alias("ratio"), status.alias("status"))


def trigger_patterns(spark, d):
    out = None
    for kind in ("spatial", "color", "texture", "localized"):
        t = images.triggered(_images(spark, d), kind, 6, 4, 4, 0.8).select("image_id", F.lit(kind).alias("kind"), F.sha2("pixels", 256).alias("digest"))
        out = t if out is None else out.union(t)
    return out


def image_preprocess(spark, d):
    steps = [("resize", 24, 24), ("center_crop", 16, 16), ("pad", 1, 0.0), ("scale", 0.0, 1.0), ("normalize", [0.5, 0.5, 0.5], [0.25, 0.25, 0.25])]

    def run(a: np.ndarray) -> dict:
        x = images.preprocess(a, steps)
        return {"mean": float(x.mean()), "std": float(x.std()), "low": float(x.min()), "high": float(x.max())}

    return _rounded(images.measure(_images(spark, d), run, ["mean", "std", "low", "high"]), 5)


def _tensors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("data"))
    odd = F.when(F.col("vec_id") % 10 == 0, float("nan")).when(F.col("vec_id") % 10 == 1, float("inf")).when(F.col("vec_id") % 10 == 2, 300.0).when(F.col("vec_id") % 10 == 3, -0.5)
    return e.withColumn("data", F.transform("data", lambda x, i: F.when((i == 5) & odd.isNotNull(), odd).otherwise(x)))


def tensor_summary(spark, d):
    s = inference.summarize(F.col("data"))
    return _rounded(_tensors(spark, d).select("vec_id", *(c.alias(n) for n, c in s.items())))


def output_faults(spark, d):
    """Softmax of ten components, some scaled, made negative, or not finite."""
    p = _tensors(spark, d).withColumn("data", F.transform(F.slice("data", 1, 10), lambda x: F.exp(x * 2)))
    p = p.withColumn("p", F.transform("data", lambda x: x / F.aggregate("data", F.lit(0.0), lambda a, y: a + y)))
    p = p.withColumn("p", F.when(F.col("vec_id") % 10 == 5, F.transform("p", lambda x: x * 0.9)).when(F.col("vec_id") % 10 == 6, F.transform("p", lambda x, i: F.when(i == 0, -x).otherwise(x))).otherwise(F.col("p")))
    return p.select("vec_id", F.array_join(inference.classification_faults(F.col("p")), ",").alias("faults"))


def embedding_faults(spark, d):
    return _tensors(spark, d).select("vec_id", F.array_join(inference.embedding_faults(F.col("data")), ",").alias("faults"))


def _boxes(spark, d, shift):
    i = table(spark, d, "lineitem")
    x, y = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    w, h = F.col("l_quantity") + 5, F.col("l_quantity") * 0.5 + 8
    return i.select("l_orderkey", F.array(x + shift, y, x + shift + w, y + h).alias("box"), (F.col("l_linenumber") % 3).alias("label"), (1 - F.col("l_discount") - F.col("l_partkey") / 1e7 - F.col("l_suppkey") / 1e9).alias("score"), "l_partkey", "l_suppkey", "l_linenumber")


def detection_faults(spark, d):
    b = _boxes(spark, d, 0.0)
    f = inference.detection_faults(F.col("box"), F.col("score"), F.col("label"), F.lit(90.0), F.lit(60.0), 2)
    return b.groupBy(F.array_join(F.array_sort(f), ",").alias("faults")).agg(F.count("*").alias("n"))


def detection_matching(spark, d):
    return _rounded(inference.match_detections(_boxes(spark, d, 0.0), _boxes(spark, d, 3.0), "l_orderkey"))


def box_iou(spark, d):
    b = _boxes(spark, d, 0.0)
    moved = F.array(*(F.get("box", F.lit(i)) + (2.0 if i % 2 == 0 else -1.0) for i in range(4)))
    return _rounded(b.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", inference.iou(F.col("box"), moved).alias("iou")))


def box_geometry(spark, d):
    """Boxes as centre and sides, back to corners, their area and how far their centres lie from those of the boxes moved and grown."""
    b = _boxes(spark, d, 0.0)
    centred = inference.box_form(F.col("box"), "xyxy", "cxcywh")
    again = inference.box_form(centred, "cxcywh", "xyxy")
    moved = inference.box_form(F.transform(inference.box_form(F.col("box"), "xyxy", "xywh"), lambda x, i: x + F.when(i % 2 == 0, 3.0).otherwise(1.0)), "xywh", "xyxy")
    parts = {n: F.get(centred, F.lit(i)) for i, n in enumerate(("cx", "cy", "w", "h"))}
    return _rounded(b.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *(c.alias(n) for n, c in parts.items()), inference.box_area(again).alias("area"), inference.displacement(again, moved).alias("displacement")))


def mask_agreement(spark, d):
    e = table(spark, d, "embeddings")
    cls = lambda x, at: F.when(x > 0.1, 2).when(x > at, 1).otherwise(0)
    m = e.select("vec_id", F.transform("embedding", lambda x: cls(x, 0.0)).alias("a"), F.transform("embedding", lambda x: cls(x, -0.02)).alias("b"))
    c = inference.mask_agreement(F.col("a"), F.col("b"), 3)
    return m.select("vec_id", *(F.round(x, 6).alias(n) for n, x in c.items()))


def stage_rollup(spark, d):
    s = F.when(F.col("value") > 450, "FAILED").when(F.col("value") > 400, "INCOMPLETE").when(F.col("value") > 350, "UNVERIFIABLE").otherwise("VERIFIED")
    e = table(spark, d, "events").select(F.concat_ws("-", "user_id", F.to_date("ts")).alias("run"), F.col("event_type").alias("stage"), s.alias("status"))
    return inference.stage_rollup(e, "run").withColumn("failed", F.array_join("failed", ","))


def json_projection(spark, d):
    return table(spark, d, "events").select("event_id", text.dotted(F.col("props"), "k").alias("k"))


def vocabulary_filter(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(text.names_any(F.col("text"), ["idiot", "stupid", "moron"])).groupBy("source").agg(F.count("*").alias("n"))


def mutation_suite(spark, d):
    """Each damage to the orders or embeddings against its undamaged twin: does the drift gate see it, and only it? All cases are groups of one table, so that each statistic is one plan."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.abs(F.hash("o_orderpriority") % 5).alias("label"), F.lit("c").alias("contributor"))
    cases = {
        "shift_feature": mutations.shift_feature(o, "o_totalprice", 60000.0), "scale_feature": mutations.scale_feature(o, "o_totalprice", 1.6), "drop_none": o,
        "flip_labels": mutations.flip_labels(o, "o_orderkey", "label", 5, 0.4), "target_label": mutations.target_label(o, "o_orderkey", "label", 1, 2, 0.9),
    }
    side = lambda df, mutation, t: df.select(mutation.alias("mutation"), F.lit(t).alias("is_target"), "o_totalprice", F.col("label").cast("string").alias("label"))
    pairs = reduce(DataFrame.union, (side(hurt, F.lit(name), True) for name, hurt in cases.items()), side(o, F.explode(F.array(*map(F.lit, cases))), False))
    prices = materialize(drift.pooled(drift.melt(pairs, F.col("is_target"), ["o_totalprice"], ["mutation"]), ["mutation", "feature"]), "prices")  # edges and bins both read it
    num = drift.psi(prices, ["mutation", "feature"]).select("mutation", (F.col("psi") >= 0.10).alias("num"))
    cat = drift.categorical(pairs, keys=["mutation"]).select("mutation", (F.col("tvd") >= 0.05).alias("cat"))
    return num.join(F.broadcast(cat), "mutation").select("mutation", mutations.outcome(F.lit(False), F.col("num") | F.col("cat")).alias("outcome"))  # a row a case


QUERIES = {
    "stream_tumbling": stream_tumbling, "stream_sliding": stream_sliding, "stream_sessions": stream_sessions, "stream_dedupe": stream_dedupe, "stream_replay_state": stream_replay_state, "stream_late_rows": stream_late_rows, "catalog_ingest": catalog_ingest,
    "image_descriptors": image_descriptors, "image_quality": image_quality, "image_findings": image_findings, "image_hashes": image_hashes, "image_drift": image_drift,
    "perturbation_sensitivity": perturbation_sensitivity, "trigger_patterns": trigger_patterns, "image_preprocess": image_preprocess, "tensor_summary": tensor_summary, "output_faults": output_faults,
    "embedding_faults": embedding_faults, "detection_faults": detection_faults, "detection_matching": detection_matching, "box_iou": box_iou, "box_geometry": box_geometry, "mask_agreement": mask_agreement, "stage_rollup": stage_rollup,
    "json_projection": json_projection, "vocabulary_filter": vocabulary_filter, "mutation_suite": mutation_suite,
}

_TENS = """tn AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i = 6 AND vec_id % 10 = 0 THEN 'nan'::DOUBLE WHEN i = 6 AND vec_id % 10 = 1 THEN 'inf'::DOUBLE WHEN i = 6 AND vec_id % 10 = 2 THEN 300.0 WHEN i = 6 AND vec_id % 10 = 3 THEN -0.5 ELSE x END) AS data FROM embeddings)"""
_BOX = """bx AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_partkey % 50)::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE AS y1, (l_partkey % 50) + (l_quantity + 5) AS x2, (l_suppkey % 40) + (l_quantity * 0.5 + 8) AS y2, l_linenumber % 3 AS label FROM lineitem)"""
_PIX = """px AS (SELECT p_partkey AS k, x, y, ((x * (p_partkey % 7 + 1) + y * (p_partkey % 5 + 1) + p_partkey) % 256)::DOUBLE AS r, ((x * (p_partkey % 7 + 1) + y * (p_partkey % 5 + 1) + 40 + p_partkey) % 256)::DOUBLE AS g, ((x * (p_partkey % 7 + 1) + y * (p_partkey % 5 + 1) + 80 + p_partkey) % 256)::DOUBLE AS b
  FROM part, (SELECT unnest(range(0, 32)) AS x), (SELECT unnest(range(0, 32)) AS y)), gr AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS v, greatest(r, g, b) / 255 AS hi, least(r, g, b) / 255 AS lo FROM px)"""

SQL = {
    "box_geometry": f"""WITH {_BOX} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h, round((x2 - x1) * (y2 - y1), 6) AS area,
  round(sqrt(pow(3 + 3.0 / 2, 2) + pow(1 + 1.0 / 2, 2)), 6) AS displacement FROM bx""",
    "stream_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": "WITH x AS (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS start, event_type, value FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY ALL",
    "stream_sessions": """WITH a AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, TRUE)::INTEGER AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM b GROUP BY user_id, s""",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_replay_state": """WITH a AS (SELECT user_id, event_id, floor(value)::BIGINT AS nonce, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_id % 97 <> 9),
k AS (SELECT user_id, count(*) FILTER (event_id > p + 1) AS n_gaps, count(*) FILTER (event_id <= p) AS n_back, count(*) - count(DISTINCT nonce) AS n_replayed FROM a GROUP BY 1)
SELECT user_id, count(*) AS n, coalesce(any_value(n_gaps), 0) AS n_gaps, coalesce(any_value(n_back), 0) AS n_back, coalesce(any_value(n_replayed), 0) AS n_replayed, count(*) FILTER (event_id % 97 = 9) AS n_unknown FROM events LEFT JOIN k USING (user_id) GROUP BY 1""",
    "stream_late_rows": """WITH e AS (SELECT event_id, event_type, event_id * 4 // count(*) OVER () AS part, event_id % 50 AS k, ts - CASE WHEN event_id % 50 = 11 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END AS seen FROM events),
w AS (SELECT part, max(max(seen)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark FROM e WHERE k NOT IN (3, 5, 7) GROUP BY part)
SELECT event_type, CASE WHEN k IN (3, 5) THEN 'MISSING_TIME' WHEN k = 7 THEN 'INVALID_TIME' WHEN seen < mark THEN 'TOO_LATE' END AS reason, count(*) AS n, sum(event_id)::BIGINT AS ids FROM e JOIN w USING (part) GROUP BY ALL""",
    "catalog_ingest": """SELECT 'documents' AS name, count(*) AS n, count(*) AS n_contents, TRUE AS gapless FROM (SELECT DISTINCT lang, source, text FROM documents) UNION ALL SELECT 'sources', count(*), count(*), TRUE FROM (SELECT DISTINCT source, lang FROM documents)""",
    "image_descriptors": f"""WITH {_PIX}, lp AS (SELECT k, lag(v) OVER rx + lead(v) OVER rx + lag(v) OVER ry + lead(v) OVER ry - 4 * v AS l FROM gr WINDOW rx AS (PARTITION BY k, y ORDER BY x), ry AS (PARTITION BY k, x ORDER BY y)), lv AS (SELECT k, var_pop(l) AS l FROM lp GROUP BY 1),
hs AS (SELECT k, floor(v)::INTEGER AS bin, count(*) / 1024.0::DOUBLE AS p FROM gr GROUP BY ALL), en AS (SELECT k, -sum(p * log2(p)) AS e FROM hs GROUP BY 1),
ag AS (SELECT k, avg(v) AS mv, stddev_pop(v) AS sv, avg(r) AS rm, avg(g) AS gm, avg(b) AS bm, stddev_pop(r) AS rs, stddev_pop(g) AS gs, stddev_pop(b) AS bs, avg((v <= 0 OR v >= 255)::INTEGER) AS cl, avg(CASE WHEN hi > 1e-6 THEN (hi - lo) / (hi + 1e-6) ELSE 0 END) AS sa FROM gr GROUP BY 1)
SELECT k AS image_id, 32::DOUBLE AS width, 32::DOUBLE AS height, 3::DOUBLE AS channels, 3072::DOUBLE AS n_bytes, 1.0::DOUBLE AS aspect_ratio, round(mv, 6) AS mean_intensity, round(sv, 6) AS std_intensity, round(mv, 6) AS brightness, round(sv, 6) AS rms_contrast, round(e, 6) AS entropy, round(rm, 6) AS r_mean, round(gm, 6) AS g_mean, round(bm, 6) AS b_mean, round(rs, 6) AS r_std, round(gs, 6) AS g_std, round(bs, 6) AS b_std,
  round(l, 6) AS laplacian_variance, round(cl, 6) AS clipping, round(sa, 6) AS mean_saturation FROM ag JOIN lv USING (k) JOIN en USING (k)""",
    "tensor_summary": f"""WITH {_TENS}, s AS (SELECT *, list_filter(data, lambda x: isfinite(x)) AS f FROM tn)
SELECT vec_id, len(data)::BIGINT AS n, len(list_filter(data, lambda x: isnan(x)))::BIGINT AS n_nan, len(list_filter(data, lambda x: x = 'inf'::DOUBLE))::BIGINT AS n_pos_inf, 0::BIGINT AS n_neg_inf, round(list_min(f), 6) AS low, round(list_max(f), 6) AS high, round(list_sum(f) / len(f), 6) AS mean,
  CASE WHEN list_min(f) >= 0 AND list_max(f) <= 1 THEN 'UNIT' WHEN list_min(f) >= -1 AND list_max(f) <= 1 THEN 'SIGNED_UNIT' WHEN list_min(f) >= 0 AND list_max(f) <= 255 THEN 'BYTE' ELSE 'UNBOUNDED' END AS range_class FROM s""",
    "output_faults": "SELECT vec_id, CASE vec_id % 10 WHEN 0 THEN 'NON_FINITE' WHEN 1 THEN 'NON_FINITE' WHEN 5 THEN 'SUM_NOT_ONE' WHEN 6 THEN 'OUT_OF_RANGE,SUM_NOT_ONE' ELSE '' END AS faults FROM embeddings",
    "embedding_faults": f"WITH {_TENS} SELECT vec_id, CASE WHEN vec_id % 10 IN (0, 1) THEN 'NON_FINITE' WHEN abs(sqrt(list_dot_product(data, data)) - 1) > 1e-3 THEN 'NOT_UNIT' ELSE '' END AS faults FROM tn",
    "detection_matching": """WITH RECURSIVE b AS (SELECT l_orderkey AS k, row_number() OVER () AS id, (l_partkey % 50)::DOUBLE AS x1, (l_suppkey % 40)::DOUBLE AS y1, (l_suppkey % 40)::DOUBLE + (l_quantity * 0.5 + 8) AS y2, (l_partkey % 50)::DOUBLE + (l_quantity + 5) AS x2,
  (l_partkey % 50)::DOUBLE + 3 AS u1, (l_partkey % 50)::DOUBLE + 3 + (l_quantity + 5) AS u2, l_linenumber % 3 AS label, 1 - l_discount - l_partkey / 1e7 - l_suppkey / 1e9 AS score FROM lineitem),
w AS (SELECT r.k, r.id AS r, c.id AS c, r.label = c.label AS same, r.score AS y, c.score AS z, greatest(0.0, least(r.x2, c.u2) - greatest(r.x1, c.u1)) * greatest(0.0, least(r.y2, c.y2) - greatest(r.y1, c.y1)) AS i, (r.x2 - r.x1) * (r.y2 - r.y1) + (c.u2 - c.u1) * (c.y2 - c.y1) AS a FROM b r JOIN b c ON r.k = c.k),
p AS (SELECT k, r, c, same, i / (a - i) AS iou, row_number() OVER (ORDER BY i / (a - i) DESC, same DESC, z DESC, y DESC, r, c) AS o FROM w WHERE i / (a - i) >= 0.5),
s AS (SELECT *, false AS taken FROM p UNION ALL SELECT k, r, c, same, iou, o, best FROM (SELECT *, bool_or(best) OVER (PARTITION BY r) OR bool_or(best) OVER (PARTITION BY c) AS gone FROM
  (SELECT *, o = min(o) OVER (PARTITION BY r) AND o = min(o) OVER (PARTITION BY c) AS best FROM s WHERE NOT taken)) WHERE best OR NOT gone),
m AS (SELECT k, count(*) AS n, sum(iou) AS t, count(*) FILTER (same) AS q FROM s WHERE taken GROUP BY k)
SELECT k AS l_orderkey, count(*)::INTEGER AS n_reference, count(*)::INTEGER AS n_candidate, coalesce(any_value(n), 0)::INTEGER AS n_matched, round(coalesce(any_value(t) / any_value(n), 0), 6) AS mean_iou, round(any_value(q) / any_value(n), 6) AS class_agreement FROM b LEFT JOIN m USING (k) GROUP BY k""",
    "detection_faults": f"WITH {_BOX}, f AS (SELECT array_to_string(list_filter([CASE WHEN x2 > 90 OR y2 > 60 THEN 'OUT_OF_IMAGE' END, CASE WHEN label >= 2 THEN 'UNKNOWN_CLASS' END], lambda x: x IS NOT NULL), ',') AS faults FROM bx) SELECT faults, count(*) AS n FROM f GROUP BY 1",
    "box_iou": f"""WITH {_BOX}, i AS (SELECT *, greatest(0.0, least(x2, x2 + 2) - greatest(x1, x1 + 2)) * greatest(0.0, least(y2, y2 - 1) - greatest(y1, y1 - 1)) AS inter, (x2 - x1) * (y2 - y1) AS area FROM bx)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(inter / (2 * area - inter), 6) AS iou FROM i""",
    "mask_agreement": """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN 2 WHEN x > 0.0 THEN 1 ELSE 0 END) AS a, list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN 2 WHEN x > -0.02 THEN 1 ELSE 0 END) AS b FROM embeddings),
u AS (SELECT vec_id, unnest(a) AS p, unnest(b) AS q FROM m), acc AS (SELECT vec_id, avg((p = q)::INTEGER) AS acc FROM u GROUP BY 1),
c AS (SELECT vec_id, k, count(*) FILTER (p = k AND q = k) AS i, count(*) FILTER (p = k OR q = k) AS o FROM u, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL)
SELECT vec_id, round(max(acc), 6) AS pixel_accuracy, round(avg(i::DOUBLE / o) FILTER (o > 0), 6) AS mean_iou FROM c JOIN acc USING (vec_id) GROUP BY 1""",
    "stage_rollup": """WITH s AS (SELECT user_id || '-' || ts::DATE AS run, event_type AS stage, CASE WHEN value > 450 THEN 3 WHEN value > 400 THEN 2 WHEN value > 350 THEN 1 ELSE 0 END AS r FROM events)
SELECT run, (['VERIFIED', 'UNVERIFIABLE', 'INCOMPLETE', 'FAILED'])[max(r) + 1] AS status, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (r = 3), '') AS failed, count(*) AS n_stages FROM s GROUP BY 1""",
    "json_projection": "SELECT event_id, props::JSON ->> '$.k' AS k FROM events",
    "vocabulary_filter": r"SELECT source, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i)\b(idiot|stupid|moron)\b') GROUP BY 1",
}
