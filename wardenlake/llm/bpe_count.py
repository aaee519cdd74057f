"""Token counts by byte-pair merging with a heap and a linked list.

A text's symbols stand in a doubly linked list; the heap holds every adjacent pair that the vocabulary knows, keyed by rank and
place. The lowest rank is popped again and again: if both ends still stand as they were, they are merged and their two new
neighbours pushed. The count is the initial symbols less the merges (plus the further bytes of symbols that the vocabulary lacks,
which fall back to bytes); no identifier is ever made.

Where no vocabulary piece crosses the border before a word mark, a text's count is the sum over its words, so a worker keeps the
counts of words it has seen in a table of bounded size. The border is checked against the vocabulary when it is loaded; with
pieces that cross it, whole texts are merged instead.

Nulls and edges: a null or empty text has no bytes and no tokens; a very long word costs n log n; repeated rows each get their
row; a null doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices, text_bytes

MARK = "▁"
_loaded: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts as the sentencepiece library does for a BPE model with byte fallback and identity normalization."""

    def __init__(self, path: str, held_words: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or any(p.type == 4 for p in model.pieces):
            raise ValueError("only BPE models without normalization rules or user-defined symbols are counted")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.fallback = model.trainer_spec.byte_fallback
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == 1}
        self.by_words = all(MARK not in p.lstrip(MARK) for p in self.rank)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.held: dict[str, int] = {}  # words seen lately; when it is full it becomes older, and the older ones go
        self.older: dict[str, int] = {}
        self.held_words = held_words

    def merge(self, text: str) -> int:
        """Tokens of one stretch of symbols."""
        n, rank, merges = len(text), self.rank, 0
        part: list[str | None] = list(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(part[i] + part[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            a = part[i]
            if a is None or (j := right[i]) >= n or len(a) + len(part[j]) != size:
                continue  # one of the two was merged meanwhile
            part[i], part[j] = (a := a + part[j]), None
            merges += 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get(a + part[k])) is not None:
                    heappush(heap, (r, i, size + len(part[k])))
            if (h := left[i]) >= 0 and (r := rank.get(part[h] + a)) is not None:
                heappush(heap, (r, h, len(part[h]) + size))
        more = sum(len(p.encode("utf-8", "surrogatepass")) - 1 for p in part if p is not None and len(p) == 1 and p not in rank) if self.fallback else 0
        return n - merges + more

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = self.prefix + text.replace(" ", MARK)
        if not self.by_words:
            return self.merge(text)
        held, total = self.held, 0
        for w in self.words.findall(text):
            n = held.get(w)
            if n is None:
                n = self.older.get(w) or self.merge(w)
                if len(w) <= 64:
                    if len(held) >= self.held_words:
                        self.older, self.held = held, {}
                        held = self.held
                    held[w] = n
            total += n
        return total


def counter(path: str) -> PieceCounter:
    """One for each file and Python worker; a worker serves many tasks."""
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text). model: the vocabulary's file, found on every machine."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for part in slices(batches, "b"):
            texts = part.column(1)
            tokens = [count(x.decode("utf-8", "replace")) for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.as_buffer()) for x in texts], pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select("doc_id", text_bytes().alias("b")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
