"""Media columns in content-defined chunks.

A payload of 8-bit samples is cut where a rolling gear hash over the last 32 samples has its upper bits zero, so that equal stretches
give equal chunks wherever they stand. Chunks carry a digest and are compressed one by one; a payload is the ordered list of its
digests. Two payloads, or two places of one, that share a chunk keep it once: for each digest that several payloads hold, a grouped
count names one owner, the others drop their copy, and reading joins the owner's chunk back by digest. Reading decodes each chunk,
verifies its digest, joins the list in order and verifies the payload's length and digest.

The stored form of one medium (which media_bytes and media_sha256 describe, and decode() reads) is self-contained: magic, payload length,
number of chunks, for each chunk its digest, length and encoded length, then the distinct encoded chunks in order of first use.

Nulls and edges: a null or empty text is one block of padding; payloads of any length are cut and kept whole; equal payloads are
stored once and each row gets its result; a null doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, flat, materialize, slices, text_bytes

BLOCK = 576
LEAST, MOST = 256, 4096
BITS = 10  # of the hash that must be zero: a chunk has LEAST + 2**BITS samples on average
_GEAR = np.random.default_rng(2048).integers(0, 1 << 32, 256, dtype=np.uint32)
_MAGIC = b"CDC1"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each sample the sum of gear[sample j before] << j over the last 32, by doubling the stretch five times."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each payload, counted from its start. LEAST exceeds the hash's reach, so no cut looks beyond its payload."""
    found = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - BITS) == 0) + 1
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = found[np.searchsorted(found, a + 1) : np.searchsorted(found, b)].tolist()
        ends, at, k = [], a, 0
        while b - at > LEAST:
            while k < len(own) and own[k] < at + LEAST:
                k += 1
            end = min(own[k] if k < len(own) else b, at + MOST, b)
            ends.append(end - a)
            at = end
        if at < b:
            ends.append(b - a)
        out.append(ends)
    return out


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % BLOCK if text else BLOCK)


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def container(length: int, digests: list[bytes], lengths: list[int], encoded: dict[bytes, bytes]) -> bytes:
    head = _MAGIC + struct.pack("<QI", length, len(digests))
    table = b"".join(d + struct.pack("<II", n, len(encoded[d])) for d, n in zip(digests, lengths, strict=True))
    return head + table + b"".join(encoded[d] for d in dict.fromkeys(digests))


def restore(length: int, digests: list[bytes], lengths: list[int], encoded: dict[bytes, bytes]) -> bytes:
    """The payload of an ordered chunk list, each chunk and the length verified."""
    unpack, plain = zstandard.ZstdDecompressor(), {}
    for d, n in zip(digests, lengths, strict=True):
        if d not in plain:
            plain[d] = unpack.decompress(encoded[d], max_output_size=n)
            if digest(plain[d]) != d:
                raise ValueError(f"chunk {d.hex()} is damaged")
    out = b"".join(plain[d] for d in digests)
    if len(out) != length:
        raise ValueError("chunk list and length disagree")
    return out


def decode(stored: bytes) -> bytes:
    """The payload of one stored form."""
    if stored[:4] != _MAGIC:
        raise ValueError("not a chunk container")
    length, n = struct.unpack_from("<QI", stored, 4)
    digests, lengths, encoded, at = [], [], {}, 16 + 24 * n
    for i in range(n):
        d = stored[16 + 24 * i : 32 + 24 * i]
        size, packed = struct.unpack_from("<II", stored, 32 + 24 * i)
        if d not in encoded:
            encoded[d] = stored[at : at + packed]
            at += packed
        digests.append(d)
        lengths.append(size)
    return restore(length, digests, lengths, encoded)


_LISTS = "digests array<binary>, lengths array<int>, sizes array<int>, blob binary"


def _encode(with_blob: bool):
    """blob: the distinct encoded chunks in order of first use; sizes: of every chunk in the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for part in slices(batches, "b"):
            texts = part.column(part.schema.get_field_index("b")).to_pylist()
            full = [payload(t) for t in texts]
            data = np.frombuffer(b"".join(full), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in full])])
            chunks = [[p[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] for p, ends in zip(full, cuts(data, offsets), strict=True)]
            names = [[digest(c) for c in x] for x in chunks]
            ids = pa.array([hashlib.sha256(p).digest() for p in full], pa.binary())
            if not with_blob:
                columns = [part.column(part.schema.get_field_index("doc_id")), pa.array([len(t) for t in texts], pa.int64()), ids, pa.array(names, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "pid", "digests"])
                continue
            packed = [{d: press.compress(c) for d, c in dict(zip(n, x, strict=True)).items()} for n, x in zip(names, chunks, strict=True)]
            ints = pa.list_(pa.int32())
            columns = [ids, pa.array(names, pa.list_(pa.binary())), pa.array([[len(c) for c in x] for x in chunks], ints), pa.array([[len(p[d]) for d in n] for n, p in zip(names, packed, strict=True)], ints), pa.array([b"".join(p.values()) for p in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["pid", "digests", "lengths", "sizes", "blob"])

    return run


def _own(blob: bytes, digests: list[bytes], sizes: list[int]) -> dict[bytes, bytes]:
    out, at = {}, 0
    for d, n in zip(digests, sizes, strict=True):
        if d not in out:
            out[d] = blob[at : at + n]
            at += n
    return out


def _kept(row: dict) -> dict[bytes, bytes]:
    """The chunks that the store holds of a payload: those that no other payload owns."""
    gone = set(row["borrowed"] or ())
    return {d: c for d, c in _own(row["blob"], row["digests"], row["sizes"]).items() if d not in gone}


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The store's rows: borrowed chunks go."""
    for batch in batches:
        for part in slices(iter([batch]), "blob"):
            keep = ["pid", "digests", "lengths", "sizes", "borrowed"]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + [pa.array([b"".join(_kept(r).values()) for r in part.to_pylist()], pa.binary())], [*keep, "blob"])


def _lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk that other payloads borrow."""
    for batch in batches:
        for part in slices(iter([batch]), "blob"):
            lent = [(d, own[d]) for r in part.to_pylist() if r["lent"] for own in [_own(r["blob"], r["digests"], r["sizes"])] for d in r["lent"]]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in lent], pa.binary()), pa.array([c for _, c in lent], pa.binary())], ["digest", "chunk"])


def _features(data: bytes) -> str:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / len(data)
    eighths = ",".join(f"{x / len(data):.4f}" for x in counts.reshape(8, 32).sum(1).tolist())
    return f"mean={float(counts @ np.arange(256)) / len(data):.4f};entropy={-float((share * np.log2(share)).sum()):.4f};eighths={eighths}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(iter([batch]), "blob"):
            out: list[list] = [[] for _ in range(8)]
            for r in part.to_pylist():
                encoded = _kept(r) | {x["digest"]: x["chunk"] for x in r["fetched"] or ()}
                length = sum(r["lengths"])
                stored = container(length, r["digests"], r["lengths"], encoded)
                data = decode(stored)
                if (read := hashlib.sha256(data).digest()) != r["pid"]:
                    raise ValueError("the payload read back isn't the one stored")
                for column, value in zip(out, (r["pid"], len(data), read.hex(), zlib.crc32(data[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), f"chunks={len(r['digests'])};{_features(data)}", len(r["borrowed"] or ())), strict=True):
                    column.append(value)
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["pid", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_shared_chunks"])


def chunk_lists(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (doc_id, text): the rows (doc_id, n_bytes, pid), the distinct payloads (pid, their lists and encoded chunks, the digests they
    borrow and lend) and the loans (pid, digest)."""
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select("doc_id", text_bytes().alias("b"))
    listed = materialize(source.mapInArrow(_encode(False), f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, pid binary, digests array<binary>"), "lists")
    held = listed.groupBy("pid").agg(F.first("digests").alias("digests")).select("pid", F.explode(F.array_distinct("digests")).alias("digest"))
    owners = held.groupBy("digest").agg(F.min("pid").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    loans = materialize(held.join(owners, "digest").where("pid <> owner").select("pid", "digest", "owner"), "loans")
    borrowed = loans.groupBy("pid").agg(F.collect_list("digest").alias("borrowed"))
    lent = loans.select(F.col("owner").alias("pid"), "digest").distinct().groupBy("pid").agg(F.collect_list("digest").alias("lent"))
    packed = source.select("b").mapInArrow(_encode(True), f"pid binary, {_LISTS}").groupBy("pid").agg(*(F.first(c).alias(c) for c in ("digests", "lengths", "sizes", "blob")))
    return listed.select("doc_id", "n_bytes", "pid"), packed.join(borrowed, "pid", "left").join(lent, "pid", "left"), loans.select("pid", "digest")


def chunk_store(payloads: DataFrame) -> DataFrame:
    """What is to be written: a row for each distinct payload with its list and the chunks that it owns; every chunk stands once."""
    return payloads.mapInArrow(_thin, f"pid binary, {_LISTS.replace(', blob', ', borrowed array<binary>, blob')}")


def read_media(payloads: DataFrame, loans: DataFrame) -> DataFrame:
    """Reads every payload back from the chunks it owns and those it borrows: pid, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, n_shared_chunks. Lists and chunks meet where the payloads lie already, by pid; only lent chunks travel."""
    # no filter on lent here: it would sink below the exchange by pid, which then couldn't serve both uses
    chunks = payloads.mapInArrow(_lend, "digest binary, chunk binary")
    fetched = loans.join(chunks, "digest").groupBy("pid").agg(F.collect_list(F.struct("digest", "chunk")).alias("fetched"))
    schema = "pid binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_shared_chunks int"
    return payloads.drop("lent").join(fetched, "pid", "left").mapInArrow(_read, schema)


def media_features(docs: DataFrame) -> DataFrame:
    """Stores every text of docs (doc_id, text) as a payload in chunks and reads it back: a row for each row of docs."""
    rows, payloads, loans = chunk_lists(docs)
    return rows.join(read_media(payloads, loans), "pid").drop("pid")
