"""Operators on small hand-made tables: closed forms, nulls, ties, empty populations."""

import hashlib
import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardenlake.functions import special, stats
from wardenlake.operators import activation, contributors, drift, duplicates, images, inference, integrity, labels, multiple_testing, ordered, paired, population, profiles, risk, source, temporal, vectors
from wardenlake.sources import datasets, models, reports


def long(spark, ref, target):
    return spark.createDataFrame([(False, "f", float(x)) for x in ref] + [(True, "f", float(x)) for x in target], "is_target boolean, feature string, value double")


@pytest.mark.parametrize(("ref", "target", "want"), [([1] * 5, [1] * 5, (0.0, 1.0)), ([1] * 5, [2] * 5, (1.0, 0.0))])
def test_ks_of_constants(spark, ref, target, want):
    assert drift.ks(long(spark, ref, target)).select("ks", "p_value").first() == want


def test_ks_and_wasserstein_against_numpy(spark):
    rng = np.random.default_rng(1)
    for n, m, digits in ((300, 300, 1), (200, 310, 1), (2100, 40, 3), (1, 7, 0)):
        a, b = rng.normal(0, 1, n).round(digits), rng.normal(0.3, 1.2, m).round(digits)
        t = long(spark, a, b)
        pooled = np.concatenate([a, b])
        gap = max(abs((a <= x).mean() - (b <= x).mean()) for x in pooled)
        grid = np.linspace(0, 1, max(2000, n, m))
        w1 = np.mean(np.abs(np.sort(a) - np.sort(b))) if n == m else np.mean(np.abs(np.quantile(a, grid) - np.quantile(b, grid)))
        for ranges in (1, 8):
            assert abs(drift.ks(t, ranges=ranges).first()["ks"] - gap) < 1e-12
            assert abs(drift.wasserstein(t, ranges=ranges).first()["w1"] - w1) < 1e-9


@pytest.mark.parametrize(("target", "want"), [([3] * 8, 0.0), ([3] * 7 + [4], 1.0)])
def test_psi_of_a_constant_reference(spark, target, want):
    assert drift.psi(long(spark, [3] * 8, target)).first()["psi"] == want


@pytest.mark.parametrize("ranges", [1, 5])
def test_quantiles_are_exact(spark, ranges):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, 400) / 7
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    got = ordered.quantiles(df, [], "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}, ranges).first()
    assert got["n"] == 400 and np.allclose([got[c] for c in "abcde"], np.quantile(x, [0, 0.1, 0.5, 0.99, 1]))
    places = ordered.ranked(df.where("v is not null and v < 100"), [], "v", "i", ranges).orderBy("i").collect()
    assert [r["i"] for r in places] == list(range(400)) and [r["v"] for r in places] == sorted(x.tolist())


def test_categorical_single_class_and_unseen(spark):
    one = spark.createDataFrame([(False, "a"), (True, "a")], "is_target boolean, label string")
    r = drift.categorical(one).first()
    assert (r["chi_square"], r["p_value"], r["df"], r["tvd"]) == (0.0, 1.0, 1, 0.0)
    r = drift.categorical(spark.createDataFrame([(False, "a"), (False, "b"), (True, "a"), (True, "c")], "is_target boolean, label string")).first()
    assert r["unseen"] == ["c"] and r["missing"] == ["b"] and r["tvd"] == 0.5


def test_special_functions():
    assert abs(special.gamma_upper(1.5, 2.0) - 0.2614641299491106) < 1e-12 and abs(special.gamma_upper(2, 9.0) - math.exp(-9) * 10) < 1e-15
    assert abs(special.beta_cdf(0.3, 2, 5) - 0.579825) < 1e-9 and abs(special.beta_cdf(special.beta_quantile(0.025, 8, 3), 8, 3) - 0.025) < 1e-9
    assert special._clopper_pearson(3, 9, 0.05, True) is None and special._clopper_pearson(0, 10, 0.05, False) == 0.0
    assert abs(special._clopper_pearson(0, 10, 0.05, True) - (1 - 0.025**0.1)) < 1e-9


def test_corrections(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.9]
    df = spark.createDataFrame([(f"h{i}", x) for i, x in enumerate(p)], "name string, p_value double")
    bh = {r["name"]: r["adjusted_p"] for r in multiple_testing.adjust(df, "bh").collect()}
    holm = {r["name"]: r["adjusted_p"] for r in multiple_testing.adjust(df, "holm").collect()}
    assert np.allclose([bh[f"h{i}"] for i in range(5)], [0.025, 0.05, 0.05, 0.025, 0.9]) and np.allclose([holm[f"h{i}"] for i in range(5)], [0.04, 0.09, 0.09, 0.025, 0.9])
    with pytest.raises(ValueError, match="method"):
        multiple_testing.adjust(df, "guess")


def test_wilson_without_exposure(spark):
    r = spark.range(1).select(*(c.alias(n) for c, n in zip(stats.wilson(F.lit(0.0), F.lit(0.0)), "abc", strict=True))).first()
    assert tuple(r) == (0.0, 0.0, 0.0)


def test_population_rows_without_time_or_class_pass(spark):
    df = spark.createDataFrame([("1", "c", None, None), ("2", "c", "2024-01-02", "x"), ("3", "c", "2023-01-01", "x")], "sample_id string, contributor string, time string, class string")
    assert {r[0] for r in population.select_population(df, start="2024-01-01", classes=["x"]).select("sample_id").collect()} == {"1", "2"}
    a, b = population.set_identity(df, "sample_id").first(), population.set_identity(df.orderBy("time"), "sample_id").first()
    assert a == b and population.set_identity(df.limit(2), "sample_id").first()["digest"] != a["digest"]


def test_canonical_source_names(spark):
    assert [source.canonical_name(x) for x in (None, "", "  Vendor_Alpha  ", "ＡＢＣ\u0000​", "a \t b", "x" * 200)] == ["missing", "missing", "vendor_alpha", "abc", "a b", "x" * 128]


def test_windows_start_at_the_first_event(spark):
    df = spark.createDataFrame([(0,), (9,), (10,), (25,), (None,)], "s long").select(F.timestamp_seconds(F.col("s") + 1_000_003).alias("t"))
    assert sorted(r[0] for r in temporal.assign_windows(df, "t", 10).select("window_index").collect()) == [0, 0, 1, 2]
    assert sorted(r[0] for r in temporal.assign_windows(df, "t", 10, 1).select("window_index").collect()) == [0, 0, 1, 1, 2, 4, 5]  # a step is half a window at least


def test_anomaly_statuses(spark):
    base = spark.createDataFrame([("m", float(x)) for x in range(20)] + [("flat", 1.0)] * 6 + [("few", 1.0)] * 3, "metric string, value double")
    seen = spark.createDataFrame([("m", 10.0), ("m", 100.0), ("flat", 1.0), ("flat", 2.0), ("few", 9.0), ("none", 1.0), ("m", None)], "metric string, value double")
    got = {(r["metric"], r["value"]): r["status"] for r in profiles.evaluate_metrics(seen, base).collect()}
    assert got == {("m", 10.0): "NORMAL", ("m", 100.0): "ANOMALOUS", ("flat", 1.0): "NORMAL", ("flat", 2.0): "ANOMALOUS", ("few", 9.0): "INSUFFICIENT_SUPPORT", ("none", 1.0): "INSUFFICIENT_SUPPORT", ("m", None): "UNAVAILABLE"}


def test_contributor_names_and_missing_background(spark):
    df = spark.createDataFrame([(1, [" b ", "a", "a", "None", None]), (2, None), (3, ["null", " "])], "id long, c array<string>")
    rows = contributors.attribute(df, "c").select("id", "contributor", "weight").orderBy("id", "contributor").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 0.5), (1, "b", 0.5), (2, "UNATTRIBUTED", 1.0), (3, "UNATTRIBUTED", 1.0)]
    alone = contributors.attribute(spark.createDataFrame([(1, ["a"], True)], "id long, c array<string>, m boolean"), "c")
    r = contributors.rates(alone, ["m"]).first()
    assert r["bg_rate"] is None and r["differential"] is None and r["baseline_status"] == "INSUFFICIENT_BACKGROUND_SUPPORT"


def test_transition_rates_of_an_unobserved_class(spark):
    p = spark.createDataFrame([(1, 0, [0.9, 0.1, 0.0]), (2, 0, [0.2, 0.8, 0.0])], "sample_id long, observed int, probs array<double>")
    got = {(r["observed"], r["latent"]): r["rate"] for r in labels.transition_rates(p, 3).collect()}
    assert got[0, 0] == got[0, 1] == 0.5 and got[2, 2] == 1.0 and got[1, 0] == 0.0


def test_zero_vectors_raise(spark):
    with pytest.raises(Exception, match="zero vector"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.l2_normalize(F.col("v"))).collect()


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    d = np.maximum(0, 1 - v @ v.T)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(90) for j in np.argsort(d[i], kind="stable")[:3]}
    for blocks in (1, 4):
        got = vectors.neighbours(df, df, "v", "id", "id", 3, cell_rows=blocks, leave_out=True).collect()
        assert {(r["query"], r["reference"]) for r in got} == want


def test_hamming_pairs_are_complete(spark):
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 30)]
    h = base + [b ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(1, 14)), False)) for b in base for _ in range(3)] + base[:5]
    df = spark.createDataFrame(list(enumerate(h)), "id long, h long")
    want = {(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if bin((h[i] ^ h[j]) & (2**64 - 1)).count("1") <= 10}
    assert {(r["a"], r["b"]) for r in duplicates.pairs_within(df, "id", "h", 10).collect()} == want


def test_merkle_tree_is_rfc_6962(spark):
    import hashlib

    def root(leaves):
        if len(leaves) == 1:
            return leaves[0]
        k = 1 << ((len(leaves) - 1).bit_length() - 1)
        return hashlib.sha256(b"\x01" + root(leaves[:k]) + root(leaves[k:])).digest()

    for n in (1, 2, 3, 7, 12):
        fp = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        leaves = integrity.ordered_leaves(spark.createDataFrame([(f"{i:03d}", x) for i, x in enumerate(fp)], "p string, f string"), "p", "f")
        assert integrity.merkle_root(leaves).first()[0] == root([hashlib.sha256(b"\x00" + bytes.fromhex(x)).digest() for x in fp]).hex()


def test_chain_of_one_altered_record(spark):
    r = spark.createDataFrame([("p", i, f"c{i}", f"n{i}") for i in range(5)], "k string, i long, payload string, nonce string")
    chain = integrity.build_chain(r, ["k"], "i", F.col("payload"))
    bad = chain.withColumn("payload", F.when(F.col("i") == 2, "other").otherwise(F.col("payload")))
    got = integrity.verify_chain(bad, ["k"], F.col("payload")).where("size(codes) > 0").select("i", "codes").collect()
    assert [tuple(x) for x in got] == [(2, ["CONTENT_ALTERED"])] and integrity.verify_chain(chain, ["k"], F.col("payload")).where("size(codes) > 0").count() == 0


def test_lineage_worked_example(spark):
    nodes = spark.createDataFrame([("a", 0.80), ("b", 0.20)], "node string, risk double")
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    assert {r["node"]: r["effective"] for r in risk.propagate(nodes, edges).collect()} == {"a": 0.8, "b": 0.36}
    with pytest.raises(ValueError, match="cycle"):
        risk.propagate(nodes, edges.union(spark.createDataFrame([("b", "a", 1.0)], edges.schema)))


def test_long_chains_are_whole(spark):
    n = 100
    nodes = spark.createDataFrame([(f"n{i}", 0.5) for i in range(n)], "node string, risk double")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(n - 1)], "src string, dst string, weight double")
    want = [0.5]
    for _ in range(n - 1):
        want.append(round(1 - 0.5 * (1 - risk.GAMMA * want[-1]), 6))
    got = {r["node"]: r["effective"] for r in risk.propagate(nodes, edges).collect()}
    assert len(got) == n and all(abs(got[f"n{i}"] - x) < 3e-6 for i, x in enumerate(want))
    few = spark.createDataFrame([(None,), ("a",), ("b",)], "node string")
    assert {tuple(r) for r in risk.levels(few, spark.createDataFrame([("a", "b")], "src string, dst string")).collect()} == {(None, 0), ("a", 0), ("b", 1)}
    # a ring at the far end stops too
    ring = edges.union(spark.createDataFrame([("n3", "n0", 1.0)], edges.schema))
    last = nodes.where(f"node = 'n{n - 1}'")
    assert [r["node"] for r in risk.ancestors(ring, last).orderBy(F.substring("node", 2, 9).cast("int")).collect()] == [f"n{i}" for i in range(n - 1)]


def test_proof_is_never_attenuated(spark):
    e = [("p", "MODEL_INTEGRITY", "1", "PROOF", "critical", 1.0, "a", "s", None, None, None, None), ("p", "DATASET_INTEGRITY", "2", "DETECTION", "critical", 1.0, "a", "t", None, None, None, None), ("p", "MODEL_INTEGRITY", "3", "DETECTION", "critical", 1.0, "b", "u", None, None, None, None)]
    names = "project_id string, domain string, evidence_id string, layer string, severity string, confidence double, asset_id string, sample_id string, dataset_version_id string, model_fingerprint string, window_id string, source_id string"
    df = spark.createDataFrame(e, names)
    got = {r["asset_id"]: r["risk"] for r in risk.asset_risk(df, risk.domain_attenuation(df)).collect()}
    assert got["a"] == 1.0 and got["b"] == 0.75


def test_policy_missing_number_is_zero(spark):
    df = spark.createDataFrame([("x", 0.1, None, "core")], "asset_id string, risk double, score double, role string")
    rules = [{"id": "r", "priority": 1, "decision": "QUARANTINE", "conditions": [("score", "LESS_THAN", 0.5), ("role", "IN", ["core"])]}, {"id": "low", "priority": 2, "decision": "ACCEPT", "conditions": []}]
    r = risk.apply_policy(df, rules).first()
    assert (r["baseline"], r["decision"], r["rule"], r["matched"]) == ("ACCEPT", "QUARANTINE", "r", ["r", "low"])
    assert [risk.apply_policy(df.withColumn("risk", F.lit(x)), []).first()["decision"] for x in (0.0, 0.3, 0.65, 0.85, 1.0)] == ["ACCEPT", "REVIEW", "QUARANTINE", "REJECT", "REJECT"]


def test_permutation_mmd_takes_every_row(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 1, (5300, 2)), rng.normal(0.02, 1, (5200, 2))
    x, y = (spark.createDataFrame([(v,) for v in t.tolist()], "v array<double>") for t in (a, b))
    r = vectors.permutation_mmd(x, y, 0.5, permutations=20).first()
    assert abs(r["observed"] - vectors.mmd_rbf(x, y, 0.5).first()[0]) < 1e-9  # of the whole tables
    far = spark.createDataFrame([(v,) for v in (a[:60] + 2).tolist()], x.schema)
    assert vectors.permutation_mmd(x.limit(50), far, 0.5).first()["p_value"] == 1 / 101


def test_keyed_places_are_permutations():
    for n in (1, 2, 3, 10, 64, 65, 1000):
        at = vectors._places(np.arange(n), n, np.arange(40, dtype=np.uint64))
        assert all(sorted(at[:, k].tolist()) == list(range(n)) for k in range(40))
    at = vectors._places(np.arange(20), 20, np.arange(4000, dtype=np.uint64)) < 10
    assert abs(at.mean(1) - 0.5).max() < 0.04  # each row is as often on either side
    together = (at[:, None, :] == at[None, :, :]).mean(2)[np.triu_indices(20, 1)]
    assert abs(together - 9 / 19).max() < 0.04  # and so is each pair


def test_permutation_gate(spark):
    few = spark.createDataFrame([("c", 1, 0, 0)] * 9, "candidate string, trigger int, shuffled int, noise int")
    assert paired.permutation_test(few, ["candidate"]).first()["p_value"] is None
    many = spark.createDataFrame([("c", 1, 0, 0)] * 20 + [("n", 1, 1, 0)] * 20, "candidate string, trigger int, shuffled int, noise int")
    got = {r["candidate"]: r for r in paired.permutation_test(many, ["candidate"]).collect()}
    assert got["c"]["significant"] and abs(got["c"]["p_value"] - 1 / 1001) < 1e-12 and not got["n"]["significant"]


def test_detection_matching(spark):
    s = "image string, box array<double>, label int, score double"
    ref = spark.createDataFrame([("i", [0.0, 0.0, 10.0, 10.0], 1, 0.9), ("i", [20.0, 20.0, 30.0, 30.0], 2, 0.8), ("j", [0.0, 0.0, 1.0, 1.0], 1, 0.5)], s)
    got = spark.createDataFrame([("i", [0.0, 0.0, 10.0, 8.0], 1, 0.7), ("i", [1.0, 0.0, 10.0, 10.0], 1, 0.9), ("k", [0.0, 0.0, 1.0, 1.0], 1, 0.5)], s)
    rows = {r["image"]: r for r in inference.match_detections(ref, got, "image").collect()}
    assert rows["i"]["n_matched"] == 1 and abs(rows["i"]["mean_iou"] - 0.9) < 1e-9 and rows["i"]["class_agreement"] == 1.0
    assert rows["j"]["n_matched"] == rows["k"]["n_matched"] == 0 and rows["j"]["n_candidate"] == 0


def test_image_measures():
    flat = np.full((32, 32, 3), 128, np.uint8)
    q = images.quality(flat)
    assert q["blur_variance"] == q["noise_variance"] == 0 and q["uniform"] == 1.0 and q["snr_db"] == 60.0 and abs(q["color_cast"]) < 1e-2
    noisy = images.perturb(flat, "gaussian_noise", 3)
    assert images.quality(noisy)["noise_variance"] > 20 and np.array_equal(noisy, images.perturb(flat, "gaussian_noise", 3))
    rng = np.random.default_rng(1)
    a = images._back(images.resize(rng.uniform(0, 255, (8, 8, 3)), 64, 64))
    near, far = images.perturb(a, "brightness", 1), np.ascontiguousarray(a[::-1, ::-1])
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert bits(images.phash(a), images.phash(near)) <= 10 < bits(images.phash(a), images.phash(far))
    assert np.array_equal(images.preprocess(a, [("resize", 32, 32, "nearest"), ("center_crop", 16, 16), ("channels", 1)]).shape, (16, 16, 1))
    with pytest.raises(ValueError, match="larger"):
        images.preprocess(a, [("center_crop", 100, 100)])


def png(w, h):
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_image_headers():
    assert datasets.header(png(7, 5)) == ("VALID", "png", 7, 5, 3)
    assert datasets.header(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03" + b"\0" * 9) == ("VALID", "jpeg", 32, 16, 3)
    assert datasets.header(b"BM" + b"\0" * 16 + struct.pack("<iiHH", 4, -3, 1, 24)) == ("VALID", "bmp", 4, 3, 3)
    assert datasets.header(b"\x89PNG\r\n\x1a\n")[0] in ("CORRUPT", "UNSUPPORTED") and datasets.header(b"GIF89a")[0] == "UNSUPPORTED"


def test_dataset_scans(spark, tmp_path):
    coco = tmp_path / "coco"
    coco.mkdir()
    (coco / "a.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "x/1.png", "width": 4, "height": 4}, {"id": 1, "file_name": "../2.png", "width": 4, "height": 4}], "annotations": [{"id": 1, "image_id": 1, "category_id": 9, "bbox": [0, 0, 0, 2], "area": -1}, {"id": 2, "image_id": 5, "category_id": 1, "bbox": [0, 0, 1, 2]}], "categories": [{"id": 1, "name": "car"}]}))
    assert datasets.detect_format(spark, str(coco)) == "coco"
    samples, notes, faults = datasets.read_coco(spark, str(coco / "a.json"))
    assert samples.count() == 2 and notes.count() == 2
    assert {r["code"] for r in faults.collect()} == {"DUPLICATE_IMAGE", "DANGLING_IMAGE", "DANGLING_CATEGORY", "BAD_BOX", "NEGATIVE_AREA", "UNSAFE_PATH"}
    with pytest.raises(datasets.DatasetFault):
        datasets.checked(faults)
    yolo = tmp_path / "yolo"
    for d in ("images", "labels"):
        (yolo / d).mkdir(parents=True)
    (yolo / "images/a.png").write_bytes(png(100, 50))
    (yolo / "labels/a.txt").write_text("0 0.5 0.5 0.2 0.4\n1 2 0 0 0\n\n")
    (yolo / "labels/b.txt").write_text("0 0.5 0.5 0.2 0.4\n")
    assert datasets.detect_format(spark, str(yolo)) == "yolo"
    _, notes, faults = datasets.read_yolo(spark, str(yolo), ["cat"])
    r = notes.first()
    assert (r["category_name"], round(r["x"], 6), round(r["y"], 6), round(r["w"], 6), round(r["h"], 6)) == ("cat", 40, 15, 20, 20)
    assert {x["code"] for x in faults.collect()} == {"BAD_LINE", "LABEL_WITHOUT_IMAGE"}
    tree = tmp_path / "tree"
    for c in ("dog", "cat"):
        (tree / c).mkdir(parents=True)
        (tree / c / "1.png").write_bytes(png(3, 3) if c == "dog" else b"junk")
    assert datasets.detect_format(spark, str(tree)) == "imagefolder"
    samples, notes, faults = datasets.read_image_folder(spark, str(tree))
    assert {r["category_name"] for r in notes.collect()} == {"dog", "cat"} and [r["detail"] for r in faults.collect()] == ["cat/1.png"]
    bad = tmp_path / "none"
    bad.mkdir()
    (bad / "x.bin").write_bytes(b"1")
    with pytest.raises(datasets.DatasetFault, match="unknown"):
        datasets.detect_format(spark, str(bad))


def test_model_scans(spark):
    head = json.dumps({"w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}).encode()
    st = struct.pack("<Q", len(head)) + head + b"\1" * 8
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    tensor = b"\x08\x02" + b"\x10\x01" + field(8, b"w") + field(9, b"\1" * 8)
    onnx = b"\x08\x07" + field(7, field(5, tensor))
    df = spark.createDataFrame([("a", bytearray(st)), ("b", bytearray(onnx)), ("c", bytearray(st[:-2])), ("d", bytearray(b"zzzz"))], "path string, content binary")
    got = {r["path"]: r for r in models.scan(df).collect()}
    assert (got["a"]["name"], got["a"]["shape"], got["a"]["byte_length"]) == ("w", [2], 8) and got["b"]["content_hash"] == got["a"]["content_hash"] and got["b"]["dtype"] == "F32"
    assert got["c"]["status"].startswith("CORRUPT") and got["d"]["status"] == "UNSUPPORTED"


def test_canonical_json(spark):
    assert reports.canonical_json({"b": [1.0, 1e21, 1e-7, -0.0, True, None], "a": "é", "€": 1, "\U0001f600": 2}) == '{"a":"é","b":[1,1e+21,1e-7,0,true,null],"€":1,"😀":2}'.replace('"€":1,"😀":2', '"€":1,"😀":2')
    for bad in (float("nan"), 2**53, b"x"):
        with pytest.raises((ValueError, TypeError)):
            reports.canonical_json(bad)
    row = spark.createDataFrame([({"user": "u", "api_key": "k"},)], "m map<string,string>").select(reports.redact(F.col("m")).alias("m")).first()
    assert row["m"] == {"user": "u", "api_key": "[REDACTED]"} and "a\\|b" in reports.markdown(spark.createDataFrame([("a|b",)], "x string"), "T")


def test_output_profiles_edges(spark):
    from wardenlake.operators import outputs

    images = spark.createDataFrame([(1,), (2,), (None,)], "i long")
    boxes = spark.createDataFrame([(1, [0.0, 0.0, 2.0, 3.0], 0.5, 1), (1, [2.0, 2.0, 1.0, 3.0], None, None)], "i long, box array<double>, score double, label int")
    got = {r["measure"]: r for r in outputs.detection_profile(images, boxes, "i").collect()}
    assert (got["count"]["n"], got["count"]["max"], round(got["count"]["zero_share"], 6)) == (3, 2.0, 0.666667)
    assert (got["area"]["max"], got["area"]["min"], got["confidence"]["mean"]) == (6.0, 0.0, 0.5)
    assert {(r["label"], r["n"]) for r in outputs.class_frequency(boxes).collect()} == {("1", 1), ("0", 1)}
    masks = spark.createDataFrame([([0, 0, 1],), ([],), (None,)], "m array<int>")
    out = outputs.segmentation_profile(masks, "m").orderBy("class").collect()
    assert [(r["class"], r["n_pixels"], r["n_masks"], r["evaluation_case"], r["mean_iou"]) for r in out] == [(0, 2, 3, "UNAVAILABLE", None), (1, 1, 3, "UNAVAILABLE", None)]
    assert outputs.segmentation_profile(masks.limit(0), "m").count() == 0 and outputs.detection_profile(images.limit(0), boxes.limit(0), "i").count() == 0


def test_joint_drift_corrects_over_all_kinds(spark):
    from wardenlake.operators import drift, multiple_testing, outputs

    long = spark.createDataFrame([(i % 2 == 0, f, float(i % 17 + (3 if f == "b" and i % 2 else 0))) for i in range(400) for f in ("a", "b")], "is_target boolean, feature string, value double")
    labels = spark.createDataFrame([(i % 2 == 0, "c", "xyz"[i % 3 if i % 2 else 0]) for i in range(400)], "is_target boolean, feature string, label string")
    more = spark.createDataFrame([("d", 0.4, 0.03, False)], "feature string, statistic double, p_value double, practical boolean")
    got = {r["feature"]: r for r in outputs.joint_drift(long, labels, multivariate=more).collect()}
    plain = [(r["feature"], r["p_value"]) for r in drift.features(long).collect()] + [("c", drift.categorical(labels, keys=["feature"]).first()["p_value"]), ("d", 0.03)]
    want = {r["name"]: r["adjusted_p"] for r in multiple_testing.adjust(spark.createDataFrame(plain, "name string, p_value double")).collect()}
    assert {k: round(v["adjusted_p"], 12) for k, v in got.items()} == {k: round(v, 12) for k, v in want.items()}
    assert got["c"]["status"] == "MATERIAL_SHIFT" and got["d"]["status"] == "SIGNIFICANT_SHIFT" and got["a"]["status"] != "MATERIAL_SHIFT"
    assert outputs.global_drift(outputs.joint_drift(long, labels)).first()["status"] == "MATERIAL_SHIFT"


def test_times_maps_and_json(spark):
    from wardenlake.operators import outputs

    rows = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-03 00:00:00",), ("x",), ("  ",), (None,)], "t string")
    got = outputs.time_accounting(rows, "t", F.try_to_timestamp("t", F.lit("yyyy-MM-dd HH:mm:ss")), delay_s=86400).first()
    assert tuple(got) == (5, 2, 1, 1, 1)
    j = spark.createDataFrame([('{"a":1,"a":2}',), ('{"a":{"b":1,"b":2}}',), ("[1]",), (None,), ("{}",)], "j string")
    assert [r[0] for r in j.select(outputs.has_duplicate_keys(F.col("j"))).collect()] == [True, False, None, None, False]
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "2", "a": "1"}), ({"a": "1"}, {"a": "2"}), (None, None)], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in m.select(outputs.same_map(F.col("x"), F.col("y"))).collect()] == [True, False, True]
    assert m.select(outputs.merged(F.col("x"), F.col("y")).alias("z")).collect()[1]["z"] == {"a": "2"}


def test_risk_hangs_on_no_order(spark):
    """The same evidence in many orders and partitions: sums of doubles differ in their last bits, risks don't."""
    from wardenlake.operators import risk

    rows = [("p", "DATASET_INTEGRITY", f"e{i}", "DETECTION", ("high", "low", "medium")[i % 3], 0.05 * (i % 11), f"a{i % 2}", "s" if i % 4 else None, None, None, None, None) for i in range(300)]
    schema = "project_id string, domain string, evidence_id string, layer string, severity string, confidence double, asset_id string, sample_id string, dataset_version_id string, model_fingerprint string, window_id string, source_id string"
    seen = set()
    for n in range(1, 6):
        e = spark.createDataFrame(rows[::-1] if n % 2 else rows, schema).repartition(n)
        seen.add(tuple(sorted((r["asset_id"], r["risk"]) for r in risk.asset_risk(e, risk.domain_attenuation(e)).collect())))
    assert len(seen) == 1


def test_reports_say_what_they_leave_out(spark):
    from wardenlake.sources import reports

    text = reports.markdown(spark.range(7), "t", rows=5)
    assert text.count("\n| ") == 6 and "2 more rows aren't shown." in text
    assert "shown" not in reports.markdown(spark.range(5), "t", rows=5)


def test_chains_are_linear_and_keep_columns(spark):
    r = spark.createDataFrame([("a", 2, None, "x"), ("a", 1, "p", None), ("b", 1, "q", "y"), (None, 5, "z", "w")], "k string, i long, payload string, more string")
    h = lambda prev, x: hashlib.sha256((prev if x is None else f"{prev}|{x}").encode()).hexdigest()
    g = {(x["k"], x["sequence_number"]): x for x in integrity.build_chain(r, ["k"], "i", F.col("payload")).collect()}
    first = h(integrity.GENESIS, "p")
    assert g["a", 0]["record_hash"] == first and g["a", 0]["more"] is None and g["a", 1]["previous_hash"] == first
    assert g["a", 1]["record_hash"] == h(first, None) and g["b", 0]["previous_hash"] == integrity.GENESIS and g[None, 0]["i"] == 5
    assert integrity.build_chain(r.where("false"), ["k"], "i", F.col("payload")).count() == 0
    long_chain = spark.range(30_000).select(F.lit(1).alias("k"), "id")
    assert integrity.build_chain(long_chain, ["k"], "id", F.col("id")).agg(F.max("sequence_number")).first()[0] == 29_999
    assert {x["sequence_number"] for x in integrity.build_chain(r, [], "i", F.col("payload")).collect()} == {0, 1, 2, 3}


def test_graph_root(spark):
    s = lambda x: hashlib.sha256(x.encode()).hexdigest()
    a, b, c = sorted(s(x) for x in "abc")
    rows = spark.createDataFrame([(x,) for x in (c, a, b)], "h string")
    assert integrity.graph_root(rows, "h").first()[0] == s(s(a + b) + s(c + c))
    assert integrity.graph_root(rows.where("false"), "h").first()[0] == s("empty_merkle_tree")


def test_activation_criteria(spark):
    box = "array<struct<box:array<double>,label:int,score:double>>"
    b = lambda x, label=0, score=0.9: ([x, 0.0, x + 10.0, 10.0], label, score)
    row = ([0.7, 0.2, 0.1], [0.3, 0.2, 0.5], [0.5], [0.6], [b(0.0), b(50.0)], [b(2.0), b(50.0), b(80.0, 3)], [], [0, 0, 1, 1], [0, 1, 1, 2], [0, 0, 1, 1], [float("nan")], None)
    names = "p array<double>, q array<double>, one array<double>, two array<double>, " + f"c {box}, o {box}, e {box}, " + "m array<int>, n array<int>, t array<int>, bad array<double>, none array<double>"
    df = spark.createDataFrame([row], names)
    x = F.col
    made = {
        "changed": activation.prediction_changed(x("p"), x("q"), 2), "same": activation.prediction_changed(x("p"), x("p"), 2), "drop": activation.confidence_drop(x("p"), x("q"), 0.35), "no_target": activation.target_matched(x("p"), x("q"), None),
        "target": activation.target_matched(x("p"), x("q"), 2), "one": activation.prediction_changed(x("one"), x("two")), "l2": activation.tensor_distance(x("p"), x("q"), 0.5), "nan": activation.tensor_distance(x("bad"), x("one")), "missing": activation.prediction_changed(x("p"), x("none")),
        "shape": activation.tensor_distance(x("p"), x("one")), "count": activation.detection_count(x("c"), x("o")), "iou": activation.detection_iou_drop(x("c"), x("o"), at=0.15), "iou_truth": activation.detection_iou_drop(x("c"), x("o"), x("o")), "empty": activation.detection_iou_drop(x("e"), x("e")),
        "injected": activation.detection_injected(x("c"), x("o"), 3), "mask": activation.mask_disagreement(x("m"), x("n"), 3), "truth": activation.mask_truth_drop(x("m"), x("n"), x("t"), 3), "no_truth": activation.mask_truth_drop(x("m"), x("n"), F.lit(None).cast("array<int>"), 3),
        "reference": activation.mask_reference_drop(x("m"), x("n"), x("t"), 3, 0.9), "emerged": activation.mask_target_emergence(x("m"), x("n"), 2),
    }
    got = {n: df.select(c.alias("x")).first()["x"] for n, c in made.items()}
    want = {
        "changed": "ACTIVATED", "same": "NOT_ACTIVATED", "drop": "ACTIVATED", "no_target": "NOT_APPLICABLE", "target": "ACTIVATED", "one": "ACTIVATED", "l2": "ACTIVATED", "nan": "NOT_APPLICABLE", "missing": "UNAVAILABLE", "shape": "NOT_APPLICABLE",
        "count": "ACTIVATED", "iou": "ACTIVATED", "iou_truth": "NOT_ACTIVATED", "empty": "NOT_ACTIVATED", "injected": "ACTIVATED", "mask": "ACTIVATED", "truth": "ACTIVATED", "no_truth": "UNAVAILABLE", "reference": "NOT_ACTIVATED", "emerged": "ACTIVATED",
    }
    assert {n: got[n]["decision"] for n in want} == want
    assert got["changed"]["target_matched"] and got["same"]["target_matched"] is False and got["nan"]["status"] == "NON_FINITE_VALUES"
    assert abs(got["iou"]["value"] - (1 - (80 / 120 + 1) / 2)) < 1e-12 and got["empty"]["value"] == 0.0
    assert abs(got["mask"]["value"] - (1 - (1 / 2 + 1 / 3 + 0) / 3)) < 1e-12 and got["no_truth"]["status"] == "UNAVAILABLE_GROUND_TRUTH_MISSING"


def test_activation_analysis(spark):
    rows = [("strong", i, 1, 0, 0, 1) for i in range(120)] + [("weak", i, i % 2, i % 2, i % 2, 1) for i in range(60)] + [("few", i, 1, 0, 0, 1) for i in range(5)]
    got = {r["c"]: r for r in activation.analyse(spark.createDataFrame(rows, "c string, s long, trigger int, shuffled int, noise int, activated int"), "c", permutations=4999).collect()}
    assert got["strong"]["result"] == "STRONG_TRIGGER_CONSISTENCY" and got["strong"]["status"] == "PROMOTED" and got["strong"]["rank"] == 1
    assert abs(got["strong"]["low"] - 0.025 ** (1 / 120)) < 1e-9 and got["strong"]["high"] == 1.0
    assert got["weak"]["result"] == "NORMAL_SENSITIVITY_ONLY" and not got["weak"]["significant"] and got["weak"]["status"] == "NOT_PROMOTED_LOW_SEPARATION"
    assert got["few"]["result"] == "INSUFFICIENT_SUPPORT" and got["few"]["p_value"] is None and got["few"]["adjusted_p"] is None and got["few"]["low"] is None


def test_redaction_at_any_depth(spark):
    schema = "a struct<Token:int,b:array<struct<my_password:string,c:string>>>, m map<string,string>, n map<string,array<string>>, plain string, cookie struct<x:int>"
    jwt = "eyJhbGciOi.eyJzdWIi.c2ln"
    df = spark.createDataFrame([((7, [("pw", "ok"), (None, jwt)]), {"api-key": "k", "z": "v"}, {"q": [jwt, "w"]}, None, (1,)), (None, None, None, "-----BEGIN EC PRIVATE KEY-----", None)], schema)
    mask = lambda x: f"[REDACTED_SECRET:sha256_{hashlib.sha256(x.encode()).hexdigest()[:12]}]"
    one, two = reports.redacted(df).collect()
    assert one["a"].asDict(True) == {"Token": mask("7"), "b": [{"my_password": mask("pw"), "c": "ok"}, {"my_password": None, "c": mask(jwt)}]}
    assert one["m"] == {"api-key": mask("k"), "z": "v"} and one["n"] == {"q": [mask(jwt), "w"]} and one["plain"] is None and one["cookie"] == mask('{"x":1}')
    assert two["a"] is None and two["m"] is None and two["cookie"] is None and two["plain"] == mask("-----BEGIN EC PRIVATE KEY-----")


def test_audit_report_of_sparse_projects(spark):
    e = spark.createDataFrame([("p", "D1", "PROOF"), ("p", "D1", "DETECTION"), ("q", None, None)], "project_id string, domain string, layer string")
    a = spark.createDataFrame([("p", "b", 0.5), ("p", "a", 0.5), ("r", "c", None)], "project_id string, asset_id string, risk double")
    f = spark.createDataFrame([("p", "HIGH"), ("p", "high")], "project_id string, severity string")
    d = spark.createDataFrame([("p", "a", "REVIEW"), ("p", "b", "QUARANTINE")], "project_id string, asset_id string, decision string")
    got = {r["project_id"]: r for r in reports.audit_report(e, a, f, d).collect()}
    assert set(got) == {"p", "q", "r"} and (got["p"]["n_proof"], got["p"]["peak_asset_id"], got["p"]["decision"]) == (1, "a", "QUARANTINE")
    assert got["p"]["domains"] == {"D1": 2} and got["p"]["findings"] == {"high": 2} and got["p"]["n_by_decision"] == {"QUARANTINE": 1, "REVIEW": 1}
    assert got["q"]["n_assets"] == 0 and got["q"]["n_evidence"] == 1 and got["q"]["domains"] is None and got["r"]["decision"] == "ACCEPT"
    assert {r["content_hash"] for r in reports.audit_report(e, a, f, d).collect()} == {r["content_hash"] for r in got.values()}
