"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names: each operator has a defined result."""

import gzip
import hashlib
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from wardenlake.llm import bpe_count, common, langid, media_chunks, minhash, mixing, ordinal, packing, quality_mcd, queries, secret_scan, warc

LONG = "lorem ipsum dolor sit amet " * 20000
WORDS = " ".join(f"word{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, b string, n int, kept string, size string, copies int, spans string, key int, x double, pid string"
ROWS = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "one", "en", "s", 3), (4, "one", "en", "s", 3), (5, LONG, "en", "s", len(LONG)), (6, WORDS, "de", None, 1),
    (7, WORDS, "de", "t", 1), (7, WORDS, "de", "t", 1), (None, WORDS + " more", "fr", "t", 1), (None, None, None, "t", None), (8, " \t\n ", "fr", "u", 4), (9, "A b", "es", "", 3), (10, "a B", "es", "", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "n", "b", 1, "k", "s", 1, "sp", 1, 0.5, "p") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_minhash(docs, empty):
    out = minhash.near_duplicates(docs, 3, 85).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert (by[1]["n_shingles"], by[2]["n_shingles"], by[3]["n_shingles"], by[8]["n_shingles"]) == (0, 0, 1, 0)
    assert by[1]["kept"] and by[2]["component_id"] == 2  # empty ones are linked with nothing
    assert by[4]["component_id"] == 3 and not by[4]["kept"] and by[3]["kept"]
    assert by[7]["component_id"] == 6 and by[10]["component_id"] == 9  # A-Z in either case
    none = {r["n_shingles"]: r for r in out if r["doc_id"] is None}
    assert none[59]["component_id"] == 6 and not none[59]["kept"]
    assert none[0]["component_id"] is None and none[0]["kept"]
    assert minhash.near_duplicates(empty, 3, 85).count() == 0


def test_media(docs, empty):
    out = media_chunks.media_features(docs).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[1]["payload_bytes"] == by[2]["payload_bytes"] == 576 and by[1]["n_bytes"] == 0
    assert by[1]["media_sha256"] == by[2]["media_sha256"] and by[6]["feature"] == by[7]["feature"]
    assert by[5]["n_bytes"] == len(LONG) and by[5]["payload_bytes"] % 576 == 0
    assert media_chunks.media_features(empty).count() == 0


def test_quality(docs, empty):
    out = quality_mcd.quality(docs).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert (by[1]["n_words"], by[1]["base_failed"], by[1]["kept"]) == (0, True, False)
    assert by[5]["base_failed"] and by[5]["n_repeat_words"] == by[5]["n_words"] == 100000
    assert not by[6]["base_failed"] and by[6]["kept"]
    assert quality_mcd.quality(empty).count() == 0


def test_counts(docs, empty):
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = bpe_count.token_counts(docs, model).collect()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert len(out) == len(ROWS) and (by[1]["n_tokens"], by[2]["n_bytes"]) == (0, 0) and by[5]["over_limit"] and not by[6]["over_limit"]
    assert bpe_count.token_counts(empty, model).count() == 0


def test_packing(docs, empty):
    out = packing.pack(docs, queries.packing_encoder()).collect()
    assert sum(r["piece"] == 0 for r in out) == len(ROWS)
    assert all(r["length"] == 1 for r in out if r["doc_id"] in (1, 2))
    spans = {}
    for r in out:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty, queries.packing_encoder()).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a", "<html lang='en'><title>T</title><p>Hi</p></html>"), (2, None, None), (None, "http://b", ""), (1, "http://a", "<p>Hi")], "page_id long, url string, html string")
    out = warc.derivatives(warc.responses(pages)).collect()
    assert len(out) == 8
    first = [r for r in out if r["title"] == "T"]
    assert {r["warc_type"] for r in first} == {"conversion", "metadata"} and len({r["refers_to"] for r in first}) == 1
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab"))], "page_id long, record binary")
    bad = warc.derivatives(broken).collect()
    assert [r["warc_type"] for r in bad] == ["rejected", "rejected"] and all(r["reason"] for r in bad)
    assert warc.derivatives(broken.limit(0)).count() == 0


def test_warc_of_damaged_records(spark):
    """Every byte of a compressed response is damaged in turn: each record gives its rows, none fails the job."""
    page = b"<html><title>T</title><p>" + b"some text " * 20
    good = warc.response("http://a.org/", gzip.compress(page, mtime=0), "2024-01-01T00:00:00Z", (("Content-Type", "text/html"), ("Content-Encoding", "gzip")))
    packed = gzip.compress(good, mtime=0)
    rows = [(i, bytearray(x[:i] + bytes([x[i] ^ 0x55]) + x[i + 1 :]), "clash", 1) for x in (good, packed) for i in range(len(x))]
    df = spark.createDataFrame([*rows, (-1, bytearray(good), "clash", 1), (-2, bytearray(packed), "clash", 1)], "page_id long, record binary, text string, reason int").repartition(4)
    out = warc.derivatives(df).collect()
    assert {r["warc_type"] for r in out if r["page_id"] < 0} == {"conversion", "metadata"} and len([r for r in out if r["page_id"] < 0]) == 4
    assert len({(r["page_id"]) for r in out}) == max(len(good), len(packed)) + 2 and all(r["reason"] for r in out if r["warc_type"] == "rejected")
    assert sum(r["warc_type"] == "rejected" for r in out) > len(packed)


def test_warc_codings_and_digests(spark):
    page = "<p>Grüße</p>".encode()
    chunked = b"5\r\n<p>Gr\r\n9;x=1\r\n" + page[5:] + b"\r\n0\r\n\r\n"

    def made(body, *headers, **said):
        block = b"HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + body
        return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), *((k.replace("_", "-"), v) for k, v in said.items())], block)

    text = lambda data: warc.derive(data)[0][2].decode()
    raw = zlib.compressobj(wbits=-15)
    for body, coding in ((gzip.compress(page) + gzip.compress(b"<p>2"), "gzip"), (zlib.compress(page), "deflate"), (raw.compress(page) + raw.flush(), "deflate"), (zstandard.compress(page), "zstd"), (gzip.compress(zlib.compress(page)), "deflate, gzip"), (page, "identity")):
        assert text(made(body, ("Content-Encoding", coding), ("Content-Type", "text/html"))).startswith("Grüße"), coding
    assert len(page) == 14 and text(made(chunked, ("Transfer-Encoding", "chunked"))) == "Grüße"
    hexed = "sha256:" + hashlib.sha256(page).hexdigest()
    facts = warc.derive(made(chunked, ("Transfer-Encoding", "chunked"), WARC_Payload_Digest=hexed))[1][2].decode()
    assert f"source-payload-digest: {hexed}" in facts and "Transfer-Encoding: chunked" in facts
    assert text(made(chunked, ("Transfer-Encoding", "chunked"), WARC_Payload_Digest=warc.sha1(chunked))) == "Grüße"
    bad = [
        made(page, WARC_Payload_Digest="sha1:WRONG"), made(page, WARC_Payload_Digest="crc9:00"), made(page, ("Content-Type", "image/png")), made(page, ("Content-Encoding", "br")), made(b"zz\r\n", ("Transfer-Encoding", "chunked")),
        made(page, ("Content-Encoding", "gzip")), made(gzip.compress(page)[:-9], ("Content-Encoding", "gzip")),
    ]
    out = warc.derivatives(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bad)], "page_id long, record binary")).collect()
    assert [r["warc_type"] for r in out] == ["rejected"] * len(bad)
    assert [r["reason"].split()[0] for r in sorted(out, key=lambda r: r["page_id"])] == ["payload", "unknown", "not", "content", "broken", "broken", "body"]
    with pytest.raises(ValueError, match="too large"):
        warc.decoded(gzip.compress(b"0" * 5_000_000), "gzip", most=1_000_000)


def test_warc_of_a_long_page(spark):
    page = bytearray(warc.response("http://a.org/", b"<p>" + b"word " * 4_000_000, "2024-01-01T00:00:00Z"))
    [conversion] = [r for r in warc.derivatives(spark.createDataFrame([(1, page, "x")], "page_id long, record binary, title string")).collect() if r["warc_type"] == "conversion"]
    assert conversion["content_length"] == 4_000_000 * 5 - 1


def test_langid(docs, empty):
    rows = langid.document_rows(docs)
    out = langid.identify(rows, langid.train(rows)).collect()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert len(out) == len(ROWS) and not by[1]["kept"] and not by[2]["kept"] and not by[8]["kept"]
    none = langid.document_rows(empty)
    model = langid.train(none)
    assert model[0] == [] and langid.identify(none, model).count() == 0
    assert {r["kept"] for r in langid.identify(rows, model).collect()} == {False}


def test_mixing(docs, empty):
    out = mixing.mix_words(docs).collect()
    assert len(out) == len(ROWS)
    assert all(r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"] for r in out)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix_words(docs.repartition(5)).collect()), key=str)
    assert {r["target"] for r in out if r["source_size"] == 0} == {0.0}
    assert mixing.mix_words(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r["target"] for r in mixing.mix_words(blank).collect()} == {0.0}


def test_ordinal(spark, docs, empty):
    labels = spark.createDataFrame([(6, 1, 0), (5, 0, 0), (5, 0, 0), (9, None, 1), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = ordinal.train(docs, ordinal.graded(labels))
    out = ordinal.score(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r["tail_probability"] <= 1 for r in out)
    assert ordinal.train(docs, ordinal.graded(labels.limit(0))) is None
    assert all(r["kept"] for r in ordinal.score(docs, None).collect()) and ordinal.score(empty, model).count() == 0


def test_secrets(spark, docs, empty):
    out = secret_scan.secret_digests(docs).collect()
    assert len(out) == len(ROWS) and {r["n_assign"] for r in out} == {0}
    more = spark.createDataFrame([(1, 'PassWord: "abc123xyz" and api_key=short and AKIA' + "B" * 16, 5, "x"), (2, None, None, "y")], "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in secret_scan.secret_digests(more).collect()}
    assert (got[1]["n_assign"], got[1]["n_access"]) == (1, 1) and got[1]["spans"].startswith("assign:0:20,")
    clean = {r["doc_id"]: r for r in secret_scan.redacted_rows(more).collect()}
    assert clean[1]["text"] == '[ASSIGN]" and api_key=short and [ACCESS]' and clean[1]["n_chars"] == len(clean[1]["text"]) and clean[2]["text"] is None
    assert secret_scan.secret_digests(empty).count() == 0 and secret_scan.redacted_rows(empty).count() == 0


def test_words_that_a_polynomial_confuses(spark):
    """The Thue-Morse word over a, b and its counterpart: a polynomial modulo a power of two gives both the same value."""
    x = "a"
    for _ in range(11):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"{x} one two"), (4, f"{y} one two"), (5, x.upper())], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    data = np.frombuffer((x + " " + y).encode(), np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
    assert len(set(common.word_hashes(data, starts, ends, True).tolist())) == 2


def test_word_hashes_see_every_byte():
    words = [b"w" * n for n in range(1, 140)] + [b"w" * i + b"v" + b"w" * (n - i) for n in (3, 8, 15, 16, 63, 64, 65, 120) for i in range(n + 1)]
    words = list(dict.fromkeys(words))
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
    hashes = common.word_hashes(data, starts, ends, False)
    assert len(hashes) == len(words) == len(set(hashes.tolist()))
    again = np.frombuffer(b"  ".join(reversed(words)).upper(), np.uint8)  # other places, other case
    starts, ends, _ = common.word_spans(again, np.array([0, len(again)]))
    assert common.word_hashes(again, starts, ends, True)[::-1].tolist() == hashes.tolist()


def test_many_similar_texts_below_the_threshold(spark):
    """Every pair of 60 texts passes a loose estimate: the dense block's texts meet and none is linked; brute force agrees."""
    rng = random.Random(6)
    same = [f"c{i}" for i in range(90)]
    rows = [(i, " ".join(same + [f"u{rng.randrange(10**6)}" for _ in range(12 + (i % 3))])) for i in range(60)] + [(100 + i, " ".join([*same, *("z z2 z3".split() * 4), str(i)])) for i in range(4)]
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows}
    want = {i: min(j for j in sets if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])) for i in sets}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == want and want[103] == 100 and want[0] == 0


def test_ids_at_both_ends_of_long(spark):
    ids = [-(2**63), -1, 0, 2**63 - 1]
    for i in range(len(ids)):
        docs = spark.createDataFrame([(x, WORDS) for x in ids[i:]] + [(None, WORDS)], "doc_id long, text string")
        assert {r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()} == {ids[i]}


def test_packing_long_white_space(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = 1_200_000
    texts = ["x" + " " * n + "y", "\n" * n, "x" * n, " \u00a0" * (n // 2) + "<|endoftext|>" + " " * n, "7" * n, "a " + "\u3000" * 60_000 + "\x1c b", "".join("a" + " " * 49_999 for _ in range(4)) + " " * n]
    fast = packing.encoder(*queries.packing_encoder())
    for t in texts:
        assert fast(t) == library.encode(t, add_special_tokens=False).ids
    out = packing.pack(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), queries.packing_encoder())
    assert out.agg(F.sum("length")).first()[0] == len(fast(texts[0])) + 1


def test_packing_many_small_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(100)
    out = packing.pack(docs, queries.packing_encoder()).collect()
    spans = {}
    for r in out:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= 1024
    assert len(spans) <= 1.03 * sum(r["length"] for r in out) / 1024


def test_mixing_large_and_null_ids(spark):
    """Ids above 2**53 beside null ones, and a text that a third of the rows repeat: every source meets its target."""
    rng = random.Random(9)
    rows = [(None if i % 50 == 0 else 2**60 + i, " ".join(["w"] * rng.randrange(1, 60)), f"s{i % 3}") for i in range(900)] + [(2**61 + 1, "same words here", "s1")] * 450 + [(None, "same words here", "s2")] * 450
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_words(docs)
    assert out.count() == len(rows)
    by = mixing.mixed_rows(docs).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n"))
    of = out.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") > 3 * F.col("size")).alias("over")).collect()
    assert len(of) == 3 and all(abs(r["taken"] - r["target"]) <= 3 and not r["over"] for r in of)
    assert sorted(r["n"] for r in by.collect()) == sorted(r["taken"] for r in of)


def test_words_of_mixing(spark):
    """Only the six ASCII characters of white space part words."""
    texts = [None, "", " ", "a", " a", "a ", "x\u00a0x y", "a\x0bb\x0cc\rd\te\nf", "\x1c \x00 \x85", "\U0001f600 \U0001f600\u0301 $1 \\ x", "x" * 70_000 + " \n" * 70_000 + "x"]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", mixing.n_words(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in sorted(out)] == [len(re.findall(mixing.WORDS, t or "")) for t in texts]


LARGE_TEXT = """
from pyspark.sql import SparkSession, functions as F
from wardenlake.llm import mixing
spark = SparkSession.builder.master("local[1]").config("spark.driver.memory", "600m").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 12_000_000).alias("text"), F.lit("s").alias("source"))
print("taken", mixing.mix_words(docs).first()["taken"])
"""


def test_mixing_of_a_large_text_in_a_small_heap():
    """36 MB of text in one row: a list of its words wouldn't fit."""
    run = subprocess.run([sys.executable, "-c", LARGE_TEXT], capture_output=True, text=True, timeout=120)
    assert "taken 12000000" in run.stdout, run.stderr[-2000:]


def test_few_links_go_to_few_files(spark, monkeypatch):
    """Tables of links have files by their rows, not one for each of many partitions; results are the same."""
    files = {}

    def recorded(df, name, *rows):
        out = common.materialize(df, name, *rows)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    texts = [" ".join(f"w{g}_{i}" for i in range(60)) + (f" tail{c}" if c else "") for g in range(60) for c in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    monkeypatch.setattr(minhash, "materialize", recorded)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert out == {i: (i - i % 3, i % 3 == 0) for i in range(180)}
    assert len(files["edges"]) > 2 and {n for t in ("edges", "joined", "components") for n in files[t]} == {1}
