"""Shared pieces of the corpus operators: bounded Arrow slices, vectorised word hashes, tables in the shared folder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import discard, materialize  # noqa: F401  the operators take them from here

SLICE_BYTES = 2 << 20
BATCH_ROWS = 1000


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each made longer until it clashes with no taken one (Spark compares them without case)."""
    low, out = {x.lower() for x in taken}, []
    for n in names:
        while n.lower() in low:
            n += "_"
        out.append(n)
    return out


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: texts of a hundred thousand characters then stay within a Python worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_bytes(name: str = "text"):
    """The text as UTF-8 bytes, null as none: bytes skip decoding in Python."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b""))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches (without copying) so that a slice holds about limit bytes of a binary column, one row at least."""
    for batch in batches:
        sizes = np.diff(offsets_of(batch.column(batch.schema.get_field_index(column))))
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start, len(sizes) - start)


def offsets_of(array: pa.Array) -> np.ndarray:
    if pa.types.is_large_binary(array.type):
        return np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    if len(array) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).astype(np.int64)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array without nulls, and each value's place among them."""
    off = offsets_of(array)
    data = array.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


# --- word hashes -------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LONG_WORD = 64  # bytes; longer words are hashed by blake2b


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ among the bytes, and for each document its first word's number (and the total)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word: its stretches of 8 bytes are mixed in one after another, so that it isn't linear in the bytes."""
    h = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    if len(starts) == 0:
        return h
    padded = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    stretch = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    now = np.arange(len(starts))
    for at in range(0, LONG_WORD, 8):
        left = ends[now] - starts[now] - at
        now, left = now[left > 0], left[left > 0]
        if not len(now):
            break
        part = stretch[starts[now] + at].view("<u8").ravel()
        part &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - np.minimum(left, 8).astype(np.uint64)) * np.uint64(8))
        h[now] = mix((h[now] ^ part) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at + 1))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n]
    for j in range(1, k):
        h = mix(h * np.uint64(0xA0761D6478BD642F) + words[j : j + n])
    return h if k > 1 else mix(h)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its runs of k lower-cased words; with fewer words, of the whole sequence."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, True)
    runs, out = window_hashes(words, k), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(mix(window_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


SMALL_ROWS = 20_000


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a table that is written already; it is broadcast only if it has few rows, counted here, else shuffled."""
    return df.join(F.broadcast(small) if small.count() <= SMALL_ROWS else small, on, how)
