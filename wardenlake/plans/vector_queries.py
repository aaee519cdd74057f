"""Queries of vectors, novelty, kernels and near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..operators import duplicates, representation, vectors

#: Of the embeddings table.
DIMENSION = 64


def _embeddings(spark, d):
    return table(spark, d, "embeddings")


def l2_normalize(spark, d):
    e = _embeddings(spark, d).select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


def cosine_knn(spark, d):
    e = _embeddings(spark, d).select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("v"))
    n = vectors.neighbours(e, e, "v", "vec_id", "vec_id", 10, leave_out=True)
    return n.groupBy(F.col("query").alias("vec_id")).agg(F.round(F.avg("distance"), 6).alias("mean_distance"), F.round(F.max("distance"), 6).alias("kth_distance"))


def ood_mad_threshold(spark, d):
    out = vectors.novelty_threshold(_embeddings(spark, d), "embedding", "vec_id")
    return out.select(F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round("tau", 6).alias("tau"))


def ood_findings(spark, d):
    """The embeddings with every fortieth one turned around."""
    e = _embeddings(spark, d).withColumn("embedding", F.when(F.col("vec_id") % 40 == 0, F.transform("embedding", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))).otherwise(F.col("embedding")))
    out = vectors.novelty(e, "embedding", "vec_id", "label")
    return out.select(F.col("id").alias("vec_id"), F.round("global_distance", 6).alias("global_distance"), F.round("local_distance", 6).alias("local_distance"), F.round("novelty", 5).alias("novelty"), "category", "severity")


def _replayed(spark, d):
    """Each vector beside a copy that is off by a little in every component."""
    e = _embeddings(spark, d)
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"), F.transform("embedding", lambda x, i: x.cast("double") * 1.01 + (i - 32) * 1e-4).alias("b"))


def tensor_stability(spark, d):
    r = _replayed(spark, d)
    return r.select("vec_id", *(F.round(c, 6).alias(n) for n, c in vectors.compare(F.col("a"), F.col("b")).items()))


def _softmax(v):
    e = F.transform(v, lambda x: F.exp(x * 4.0))
    return F.transform(e, lambda x: x / vectors.total(e))


def classification_stability(spark, d):
    """The first ten components as class scores, before and after a shift."""
    r = _replayed(spark, d).select("vec_id", F.slice("a", 1, 10).alias("a"), F.slice(F.transform("b", lambda x, i: x + F.when(i == 3, 0.15).otherwise(0.0)), 1, 10).alias("b"))
    r = r.select("vec_id", _softmax(F.col("a")).alias("p"), _softmax(F.col("b")).alias("q"))
    c = vectors.compare_classes(F.col("p"), F.col("q"), 5)
    return r.select("vec_id", c["agrees"].alias("agrees"), *(F.round(c[n], 6).alias(n) for n in c if n != "agrees"))


def replay_compare(spark, d):
    """Elements within atol + rtol * |recorded|, and the status of each vector."""
    r = _replayed(spark, d)
    off = F.zip_with("a", "b", lambda x, y: (F.abs(y - x) > 1e-3 + 5e-3 * F.abs(x)).cast("int"))
    n = F.aggregate(off, F.lit(0), lambda a, x: a + x)
    worst = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(y - x)))
    status = F.when(worst == 0, "EXACT_MATCH").when(n == 0, "WITHIN_TOLERANCE").otherwise("MISMATCH")
    return r.select("vec_id", n.alias("n_off"), F.round(worst, 6).alias("max_abs"), status.alias("status"))


def _halves(spark, d):
    e = _embeddings(spark, d).select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.where("label < 5").select("v"), e.where("label >= 5").select("v")


def mmd_rbf(spark, d):
    x, y = _halves(spark, d)
    return vectors.mmd_rbf(x, y, 0.5).select(F.round("mmd2", 6).alias("mmd2"))


def energy_distance(spark, d):
    x, y = _halves(spark, d)
    return vectors.energy_distance(x, y).select(F.round("energy", 6).alias("energy"))


def mmd_permutation(spark, d):
    x, y = _halves(spark, d)
    return vectors.permutation_mmd(x, y, vectors.median_gamma(x, y)).select(F.round("observed", 6).alias("observed"), "p_value")


def mmd_sketch_permutation(spark, d):
    """The same test from random Fourier features: linear in the rows."""
    x, y = _halves(spark, d)
    return vectors.sketched_permutation_mmd(x, y, vectors.median_gamma(x, y)).select(F.round("observed", 6).alias("observed"), "p_value")


def energy_sketch(spark, d):
    x, y = _halves(spark, d)
    return vectors.sliced_energy(x, y).select(F.round("energy", 6).alias("energy"), F.round("error", 6).alias("error"))


def _models(spark, d):
    """Embeddings of five models, labels from 5 up being the target's; some extractions failed or are too short."""
    k, e = F.col("vec_id"), F.col("embedding")
    broken = F.when(k % 37 == 0, F.lit(None)).when(k % 41 == 0, F.slice(e, 1, 3)).when(k % 43 == 0, F.transform(e, lambda x: x * 0)).otherwise(e)
    return _embeddings(spark, d).select((F.col("label") % 5).alias("model"), (F.col("label") >= 5).alias("is_target"), broken.alias("embedding"))


def representation_accounting(spark, d):
    return representation.representation_accounting(_models(spark, d), ["model"], "embedding", DIMENSION)


def representation_drift(spark, d):
    """Drift of each model's embeddings: accounting, MMD and energy distance, status and severity."""
    out = representation.representation_drift(_models(spark, d), ["model"], "embedding", DIMENSION)
    return out.select(*(F.round(c, 6).alias(c) if c in ("gamma", "mmd2", "error", "energy") else F.col(c) for c in out.columns))


def _prints(spark, d):
    """Each vector, and a copy of it with five or six components turned around."""
    e = _embeddings(spark, d).select("vec_id", "embedding")
    e = e.union(e.select(F.col("vec_id") + 1_000_000, F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 11 == 0, -x).otherwise(x))))
    h = e.select(F.col("vec_id").alias("sample_id"), duplicates.sign_hash(F.col("embedding")).alias("phash"), duplicates.sign_hash(F.transform("embedding", lambda x, i: x + F.when(i % 5 == 0, 0.02).otherwise(0.0))).alias("dhash"))
    return h


def sign_hash64(spark, d):
    return _prints(spark, d).select("sample_id", duplicates.to_hex(F.col("phash")).alias("hex"), (duplicates.from_hex(duplicates.to_hex(F.col("phash"))) == F.col("phash")).alias("round_trip"))


def _related(strategy):
    def run(spark, d):
        return duplicates.relationships(_prints(spark, d), strategy=strategy).select("a", "b", F.col("p_distance").cast("int").alias("p_distance"), F.col("d_distance").cast("int").alias("d_distance"), "similarity", "exact")

    return run


def dup_clusters(spark, d):
    return duplicates.named_clusters(duplicates.duplicate_groups(_prints(spark, d), strategy="any"))


def exact_dup_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


QUERIES = {
    "l2_normalize": l2_normalize, "cosine_knn": cosine_knn, "ood_mad_threshold": ood_mad_threshold, "ood_findings": ood_findings, "tensor_stability": tensor_stability,
    "classification_stability": classification_stability, "replay_compare": replay_compare, "mmd_rbf": mmd_rbf, "energy_distance": energy_distance, "mmd_permutation": mmd_permutation, "mmd_sketch_permutation": mmd_sketch_permutation, "energy_sketch": energy_sketch, "representation_accounting": representation_accounting, "representation_drift": representation_drift,
    "sign_hash64": sign_hash64, "hamming_pairs_both": _related("both"), "hamming_pairs_any": _related("any"), "hamming_pairs_weighted": _related("weighted"), "dup_clusters": dup_clusters,
    "exact_dup_docs": exact_dup_docs,
}

_U = "u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM {src})"
_TURNED = "src AS (SELECT vec_id, label, CASE WHEN vec_id % 40 = 0 THEN list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 1 THEN -x ELSE x END) ELSE embedding END AS embedding FROM embeddings)"
_PAIRS = "pr AS (SELECT a.vec_id AS q, b.vec_id AS r, a.label = b.label AS same, greatest(0.0, 1.0 - list_dot_product(a.v, b.v)) AS dist FROM u a JOIN u b ON a.vec_id <> b.vec_id)"
_NOVEL = f"""{_PAIRS}, g AS (SELECT q, avg(dist) AS gd FROM (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(dist, 12), r) <= 10) GROUP BY q),
lo AS (SELECT q, avg(dist) AS ld FROM (SELECT * FROM pr WHERE same QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(dist, 12), r) <= 10) GROUP BY q),
md AS (SELECT median(gd) AS med FROM g), ma AS (SELECT med, median(abs(gd - med)) AS mad FROM g, md GROUP BY med), ta AS (SELECT med, mad, med + 3.5 * greatest(1e-4, 1.4826 * mad) AS tau FROM ma)"""
_REP = "rp AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda x, i: x * 1.01 + (i - 33) * 1e-4) AS b FROM embeddings)"
_HALVES = "h AS (SELECT label < 5 AS lo, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT x.lo AS xl, y.lo AS yl, greatest(0.0, list_dot_product(x.v, x.v) + list_dot_product(y.v, y.v) - 2 * list_dot_product(x.v, y.v)) AS d2 FROM h x, h y)"
_HASH = """embs AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x, i: CASE WHEN (vec_id + i - 1) % 11 = 0 THEN -x ELSE x END) FROM embeddings),
hs AS (SELECT vec_id AS sample_id, list_reduce(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN set_bit(repeat('0', 64)::BIT, (64 - i)::INTEGER, 1) ELSE repeat('0', 64)::BIT END), lambda p, q: p | q) AS pb,
  list_reduce(list_transform(embedding, lambda x, i: CASE WHEN x + (CASE WHEN (i - 1) % 5 = 0 THEN 0.02 ELSE 0 END) > 0 THEN set_bit(repeat('0', 64)::BIT, (64 - i)::INTEGER, 1) ELSE repeat('0', 64)::BIT END), lambda p, q: p | q) AS db FROM embs),
rl AS (SELECT x.sample_id AS a, y.sample_id AS b, bit_count(xor(x.pb, y.pb))::INTEGER AS p_distance, bit_count(xor(x.db, y.db))::INTEGER AS d_distance FROM hs x JOIN hs y ON x.sample_id < y.sample_id),
sm AS (SELECT *, round_even(0.6 * (1 - p_distance / 64.0::DOUBLE) + 0.4 * (1 - d_distance / 64.0::DOUBLE), 4) AS similarity, p_distance = 0 AND d_distance = 0 AS exact FROM rl)"""
_SOFT = "list_transform({0}, lambda x: exp(x * 4.0) / list_sum(list_transform({0}, lambda y: exp(y * 4.0))))"
_KL = "list_sum(list_transform(list_zip({0}, {1}), lambda z: greatest(z[1], 1e-12) * ln(greatest(z[1], 1e-12) / greatest(z[2], 1e-12))))"

SQL = {
    "representation_accounting": """WITH e AS (SELECT label % 5 AS model, label >= 5 AS t, CASE WHEN vec_id % 37 = 0 THEN 'f' WHEN vec_id % 41 = 0 THEN 'i' WHEN vec_id % 43 = 0 THEN 'f' ELSE 'v' END AS s FROM embeddings WHERE label IS NOT NULL)
SELECT model, count(*) FILTER (NOT t) AS reference_total, count(*) FILTER (NOT t AND s = 'v') AS reference_valid, count(*) FILTER (NOT t AND s = 'f') AS reference_failed, count(*) FILTER (NOT t AND s = 'i') AS reference_invalid,
  count(*) FILTER (t) AS target_total, count(*) FILTER (t AND s = 'v') AS target_valid, count(*) FILTER (t AND s = 'f') AS target_failed, count(*) FILTER (t AND s = 'i') AS target_invalid FROM e GROUP BY 1""",
    "l2_normalize": f"WITH {_U.format(src='embeddings')} SELECT vec_id, (unnest(range(1, 65)) - 1)::INTEGER AS i, round(unnest(v), 6) AS x FROM u",
    "cosine_knn": f"WITH {_U.format(src='embeddings')}, {_PAIRS}, k AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(dist, 12), r) <= 10) SELECT q AS vec_id, round(avg(dist), 6) AS mean_distance, round(max(dist), 6) AS kth_distance FROM k GROUP BY q",
    "ood_mad_threshold": f"WITH {_U.format(src='embeddings')}, {_NOVEL} SELECT round(med, 6) AS median, round(mad, 6) AS mad, round(tau, 6) AS tau FROM ta",
    "ood_findings": f"""WITH {_TURNED}, {_U.format(src='src')}, {_NOVEL}, nc AS (SELECT label, count(*) AS n FROM u GROUP BY 1), j AS (SELECT g.q AS vec_id, gd, CASE WHEN n - 1 >= 20 THEN ld END AS ld, ta.* FROM g JOIN lo ON lo.q = g.q JOIN u ON u.vec_id = g.q JOIN nc ON nc.label = u.label, ta),
k AS (SELECT *, gd > tau AS far, coalesce(ld > tau * 1.1, FALSE) AS farl FROM j)
SELECT vec_id, round(gd, 6) AS global_distance, round(ld, 6) AS local_distance, round(CASE WHEN tau > 1e-4 THEN 1 / (1 + exp(-2.0 * (gd - tau) / greatest(1e-4, 1.4826 * mad))) ELSE 0 END, 5) AS novelty,
  CASE WHEN far THEN 'GLOBAL_OOD' WHEN farl THEN 'LOCAL_SUBGROUP_OOD' ELSE 'IN_DISTRIBUTION' END AS category, CASE WHEN far OR farl THEN CASE WHEN gd < tau * 1.3 THEN 'MEDIUM' ELSE 'HIGH' END END AS severity FROM k""",
    "tensor_stability": f"""WITH {_REP}, x AS (SELECT *, list_transform(list_zip(a, b), lambda z: z[1] - z[2]) AS d FROM rp)
SELECT vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine, round(list_sum(list_transform(d, lambda z: abs(z))), 6) AS l1, round(sqrt(list_dot_product(d, d)), 6) AS l2,
  round(sqrt(list_dot_product(d, d)) / sqrt(list_dot_product(a, a)), 6) AS relative_l2, round(list_max(list_transform(d, lambda z: abs(z))), 6) AS max_abs, round(list_sum(list_transform(d, lambda z: abs(z))) / 64, 6) AS mean_abs,
  round(sqrt(list_dot_product(d, d)) / 8, 6) AS rmse, 1.0::DOUBLE AS finite_agreement FROM x""",
    "classification_stability": f"""WITH {_REP}, s AS (SELECT vec_id, a[1:10] AS a, list_transform(b, lambda x, i: x + CASE WHEN i = 4 THEN 0.15 ELSE 0 END)[1:10] AS b FROM rp), t AS (SELECT vec_id, {_SOFT.format('a')} AS p, {_SOFT.format('b')} AS q FROM s),
u AS (SELECT *, list_transform(list_zip(p, q), lambda z: (z[1] + z[2]) / 2) AS m, list_transform(list_reverse_sort(list_transform(p, lambda e, i: {{'e': e, 'i': -i}}))[1:5], lambda z: z.i) AS lp, list_transform(list_reverse_sort(list_transform(q, lambda e, i: {{'e': e, 'i': -i}}))[1:5], lambda z: z.i) AS lq FROM t)
SELECT vec_id, list_position(p, list_max(p)) = list_position(q, list_max(q)) AS agrees, round(len(list_intersect(lp, lq))::DOUBLE / len(list_distinct(list_concat(lp, lq))), 6) AS top_k_jaccard, round(list_max(q) - list_max(p), 6) AS confidence_delta,
  round((list_max(q) - list_reverse_sort(q)[2]) - (list_max(p) - list_reverse_sort(p)[2]), 6) AS margin_delta, round(abs(list_sum(list_transform(p, lambda e: e * ln(e))) - list_sum(list_transform(q, lambda e: e * ln(e)))), 6) AS entropy_delta,
  round({_KL.format('p', 'q')}, 6) AS kl, round(({_KL.format('p', 'm')} + {_KL.format('q', 'm')}) / 2, 6) AS js FROM u""",
    "replay_compare": f"""WITH {_REP}, x AS (SELECT vec_id, list_sum(list_transform(list_zip(a, b), lambda z: (abs(z[2] - z[1]) > 1e-3 + 5e-3 * abs(z[1]))::INTEGER))::INTEGER AS n_off, list_max(list_transform(list_zip(a, b), lambda z: abs(z[2] - z[1]))) AS m FROM rp)
SELECT vec_id, n_off, round(m, 6) AS max_abs, CASE WHEN m = 0 THEN 'EXACT_MATCH' WHEN n_off = 0 THEN 'WITHIN_TOLERANCE' ELSE 'MISMATCH' END AS status FROM x""",
    "mmd_rbf": f"WITH {_HALVES} SELECT round(avg(exp(-0.5 * d2)) FILTER (xl AND yl) + avg(exp(-0.5 * d2)) FILTER (NOT xl AND NOT yl) - 2 * avg(exp(-0.5 * d2)) FILTER (xl AND NOT yl), 6) AS mmd2 FROM p",
    "energy_distance": f"WITH {_HALVES} SELECT round(2 * avg(sqrt(d2)) FILTER (xl AND NOT yl) - avg(sqrt(d2)) FILTER (xl AND yl) - avg(sqrt(d2)) FILTER (NOT xl AND NOT yl), 6) AS energy FROM p",
    "sign_hash64": "WITH embs AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x, i: CASE WHEN (vec_id + i - 1) % 11 = 0 THEN -x ELSE x END) FROM embeddings) SELECT vec_id AS sample_id, lower(list_aggregate(list_transform(range(0, 16), lambda k: format('{:x}', list_sum(list_transform(range(0, 4), lambda j: CASE WHEN embedding[(15 - k) * 4 + j + 1] > 0 THEN (1 << j) ELSE 0 END))::INTEGER)), 'string_agg', '')) AS hex, TRUE AS round_trip FROM embs",
    "hamming_pairs_both": f"WITH {_HASH} SELECT * FROM sm WHERE p_distance <= 10 AND d_distance <= 10",
    "hamming_pairs_any": f"WITH {_HASH} SELECT * FROM sm WHERE p_distance <= 10 OR d_distance <= 10",
    "hamming_pairs_weighted": f"WITH {_HASH} SELECT * FROM sm WHERE similarity >= 0.84",
    "dup_clusters": f"""WITH RECURSIVE {_HASH}, ed AS (SELECT a AS x, b AS y FROM sm WHERE p_distance <= 10 OR d_distance <= 10 UNION ALL SELECT b, a FROM sm WHERE p_distance <= 10 OR d_distance <= 10),
re AS (SELECT DISTINCT x AS node, x AS reached FROM ed UNION SELECT re.node, ed.y FROM re JOIN ed ON ed.x = re.reached), rt AS (SELECT node, min(reached) AS root FROM re GROUP BY node)
SELECT 'cluster_' || root || '_' || left(sha256(string_agg(node::VARCHAR, ',' ORDER BY node::VARCHAR)), 12) AS cluster_id, count(*) AS size FROM rt GROUP BY root""",
    "exact_dup_docs": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
}
