"""Best-fit packing of token sequences with bounded space.

Each document's identifiers (ended by one more) that exceed the length are cut into full pieces; the first piece takes what is
over. Pieces then go online, in the order of their rows (of each slice of a few MB the longest first), into a fixed number of open bins: free space has one bit each in a
bitset, and the lowest set bit at or above a piece's length is the tightest bin. When all bins are open and none has room, the
fullest closes first and a new one opens. A full bin closes at once. Each input partition packs its own rows, so no document
moves, a lost task is repeated with the same result, and memory is the open bins with their pieces. The pieces whose bins are still
open at a partition's end are packed once more, those of many partitions together, so that many small partitions waste little.

Nulls and edges: a null or empty text is the end identifier alone; a text of any length is cut, never shortened; repeated rows are
packed each; a null doc_id stays null; pieces of equal length go in the order of their rows; other columns don't matter, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, slices, text_bytes

OPEN_BINS = 512
AGAIN_TOKENS = 1 << 21  # that one task packs of what partitions leave
#: White space of the encoding's pattern (the Unicode property), and how much of it in a row goes by itself: the pattern's search would run out of stack.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")
LONG_WHITE = 50_000
_encoders: dict[tuple, Callable[[str], list[int]]] = {}


class BoundedBestFit:
    """Online best fit over at most open_bins bins of one size; add() gives a bin's number and the place in it."""

    def __init__(self, size: int, open_bins: int = OPEN_BINS):
        self.size, self.limit, self.open, self.next = size, open_bins, 0, 0
        self.closed: list[int] = []  # for the caller to empty
        self.bits = 0  # bit f: a bin with f free places is open
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        b = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b

    def add(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            b = self._take(free)
        else:
            if self.open >= self.limit:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))  # least free space: the fullest closes
            free, b = self.size, self.next
            self.next += 1
        if left := free - length:
            self.by_free.setdefault(left, []).append(b)
            self.bits |= 1 << left
            self.open += 1
        else:
            self.closed.append(b)
        return b, self.size - free


def _past_white(text: str, plain: Callable[[str], list[int]], one: Callable[[str], list[int]]) -> list[int]:
    """Identifiers where long runs of white space are encoded by themselves, as the pattern cuts them: all of a run but its last
    character is one piece, the last belongs to what follows; at the text's end the run is one piece whole."""
    out, at = [], 0
    for m in _WHITE.finditer(text):
        end = m.end() - (m.end() < len(text))
        if end - m.start() >= LONG_WHITE:
            out += plain(text[at : m.start()]) + one(text[m.start() : end])
            at = end
    return out + plain(text[at:])


def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Callable[[str], list[int]]:
    """Identifiers as the tokenizers library gives them for the file vocabulary (without added ones). With ranks, a tiktoken file of
    the same vocabulary, tiktoken's faster merging makes the same identifiers; special strings are found as tokenizers finds them."""
    at = (vocabulary, ranks, pattern)
    if at not in _encoders:
        if ranks is None:
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_file(vocabulary)
            _encoders[at] = lambda text: loaded.encode(text, add_special_tokens=False).ids
        else:
            import tiktoken

            with open(vocabulary, encoding="utf-8") as f:
                special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            made = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
            one = tiktoken.Encoding("runs", pat_str=r"(?s:.+)", mergeable_ranks=merges, special_tokens={})
            plain = lambda text: made.encode_ordinary(text) if len(text) < LONG_WHITE else _past_white(text, made.encode_ordinary, one.encode_ordinary)
            if not special:
                _encoders[at] = plain
            else:
                cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
                _encoders[at] = lambda text: [i for x in cut.split(text) if x for i in ([special[x]] if x in special else plain(x))]
    return _encoders[at]


def pieces(n: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece of n identifiers: all full but the first."""
    head = n % size if n > size else n
    start = 0
    if head:
        yield 0, head
        start = head
    for at in range(start, n, size):
        yield at, size


def _placed(bins: BoundedBestFit, base: int, found: Iterator[tuple[pa.DataType, list[tuple]]], fields: list[tuple[str, pa.DataType]], keep_open: bool) -> Iterator[pa.RecordBatch]:
    """The rows of pieces (length, doc_id, piece, start, crc, ..) as their bins close, at the end the open ones', without a sequence_id unless keep_open.
    Each list goes by falling length."""
    held: dict[int, list[tuple]] = {}

    def rows(closed: list[int], named: bool) -> pa.RecordBatch:
        out = [(doc, k, start, n, crc, base + b if named else None, at, *more) for b in closed for at, (n, doc, k, start, crc, *more) in held.pop(b)]
        columns = zip(*out, strict=True) if out else [()] * (len(fields) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *(t for _, t in fields)], strict=True)], ["doc_id", *(n for n, _ in fields)])

    for kind, some in found:
        for x in sorted(some, key=lambda x: -x[0]):
            b, at = bins.add(x[0])
            held.setdefault(b, []).append((at, x))
        yield rows(bins.closed, True)
        bins.closed = []
    while held:
        yield rows(list(held)[:256], keep_open)


def pack(docs: DataFrame, encode: tuple, size: int = 1024, end_id: int = 2, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds the identifiers themselves.
    encode: the arguments of encoder()."""
    bound_batches(docs.sparkSession)
    fields = [("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset"))] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list[tuple]]]:
        ids_of = encoder(*encode)
        for part in slices(batches, "b"):
            out = []
            for doc, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.array([*ids_of(x.decode("utf-8", "replace")), end_id], "<u4")
                for k, (start, n) in enumerate(pieces(len(ids), size)):
                    own = ids[start : start + n]
                    out.append((n, doc, k, start, zlib.crc32(own.tobytes()), *[own.astype(np.int32)] * with_ids))
            yield part.column(0).type, out

    def of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list[tuple]]]:
        for x in batches:
            yield x.column(0).type, [(n, doc, k, start, crc, *more) for doc, k, start, n, crc, _, _, *more in zip(*(c.to_pylist() for c in x.columns), strict=True)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _placed(BoundedBestFit(size, open_bins), TaskContext.get().partitionId() << 40, of_texts(batches), fields, False)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _placed(BoundedBestFit(size, open_bins), 1 << 62 | TaskContext.get().partitionId() << 40, of_pieces(batches), fields, True)

    packed = materialize(docs.select("doc_id", text_bytes().alias("b")).mapInArrow(first, schema), "packed")
    left = packed.where("sequence_id is null")
    tasks = -(-int(left.agg(F.sum("length")).first()[0] or 1) // AGAIN_TOKENS)
    dealt = left.repartition(tasks).sortWithinPartitions(F.desc("length"), "ids_crc32", "doc_id", "piece", "start")  # an order of its own, so that a task done again does the same
    return packed.where("sequence_id is not null").union(dealt.mapInArrow(again, schema))
