"""The elements of the top-level arrays of large JSON files, found and parsed by byte ranges.

A file of one line and many gigabytes is one row of one task for a JSON reader. Here the text reader splits it at `}` and at the block borders that Spark
picks, and two passes over the blocks find the structure. The first knows of each block only how it would change a state that it doesn't know yet: whether a
string is open (parity of its quotes) and how deep the brackets are (for either answer). Sums over the blocks before give each block's true start. The second
pass then cuts elements out of each block. An element that crosses borders is written in pieces, one a block, which are put together afterwards, and
elements before a block's first key belong to the section that was open at its border.

A file may hold several documents, one after another. What is broadcast is one row a block. Memory: a batch of fragments and the element that is open."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import materialize

_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)
_OBJECT = ""  # a section that isn't an array: its parts are no elements


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _structure(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of brackets outside strings, +1 or -1 for each, and whether a string is open at the end. No text ends within an escape."""
    a = np.frombuffer(data, np.uint8)
    quotes = a == 34
    for i in np.flatnonzero(quotes[1:] & (a[:-1] == 92)) + 1:  # a quote after a backslash counts if the run of backslashes is even
        run = i - 1
        while run >= 0 and a[run] == 92:
            run -= 1
        quotes[i] = (i - 1 - run) % 2 == 0
    open_ = (np.cumsum(quotes) + inside) % 2 == 1
    change = ((a == 123) | (a == 91)).astype(np.int8) - ((a == 125) | (a == 93)).astype(np.int8)
    at = np.flatnonzero((change != 0) & ~open_)
    return at, change[at], bool(open_[-1]) if len(a) else inside


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """(file, block) and its bytes, in parts; every fragment gets its brace back."""
    for batch in batches:
        files, blocks, values = (batch.column(i).to_pylist() for i in range(3))
        start = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], blocks[i]) != (files[start], blocks[start]):
                yield (files[start], blocks[start]), b"".join(v + b"}" for v in values[start:i])
                start = i


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, rows, found = None, [], []
    for key, data in _blocks(batches):
        if key != now:
            now, found = key, [False, True, 0, 0]
            rows.append((key, found))
        for k in (0, 1):
            _, change, found[k] = _structure(data, found[k])
            found[2 + k] += int(change.sum())
    columns = [[k[0] for k, _ in rows], [k[1] for k, _ in rows], [int(f[0]) for _, f in rows], [f[2] for _, f in rows], [f[3] for _, f in rows]]
    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "block", "parity", "depth0", "depth1"])


class _Cutter:
    """The elements of one block, which starts inside a string or not, at a depth of brackets."""

    def __init__(self, file: str, block: int, inside: bool, depth: int):
        self.at, self.inside, self.depth = (file, block), inside, depth
        self.broken = depth > 2 or (depth == 2 and inside)  # the block starts within an element
        self.held, self.section, self.n = b"", None, 0

    def rows(self, data: bytes) -> Iterator[tuple]:
        fresh = len(self.held)
        data = self.held + data
        at, change, inside = _structure(data[fresh:], self.inside)
        at = at + fresh
        after = self.depth + np.cumsum(change)
        kinds = np.frombuffer(data, np.uint8)[at]
        begin, done = (0 if fresh or self.broken else None), 0
        # what matters: sections open (1 to 2), elements start (2 to 3, a brace) and end (3 to 2)
        for i in np.flatnonzero(((after == 2) | ((after == 3) & (change > 0)) | ((after == 1) & (change < 0)))).tolist():
            place, deep, up = int(at[i]), int(after[i]), change[i] > 0
            if deep == 2 and up:
                key = _KEY.search(data[max(done, place - 500) : place])
                self.section = key[1].decode("utf-8", "replace") if kinds[i] == 91 and key else _OBJECT
            elif deep == 3:
                begin = place if kinds[i] == 123 else None
            elif deep == 2 and begin is not None:
                yield self._row("head" if self.broken else "whole", data[begin : place + 1])
                begin, self.broken, done = None, False, place + 1
            if deep == 1 and not up:
                self.broken = False
        self.inside, self.depth = inside, int(after[-1]) if len(after) else self.depth
        self.held = data[begin:] if begin is not None else b""

    def finish(self) -> Iterator[tuple]:
        if self.held.strip(b"\r\n\t "):
            yield self._row("middle" if self.broken else "tail", self.held)
        yield self._row("mark", b"")

    def _row(self, piece: str, text: bytes) -> tuple:
        self.n += 1
        return (*self.at, self.n, piece, self.section, text.decode("utf-8", "replace"))


_CUT = "file string, block long, n long, piece string, section string, text string"


def _cut(starts: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, rows, states = None, [], starts.value

        def made() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _CUT.split(", ")])
            rows.clear()
            return out

        for key, data in _blocks(batches):
            if cutter is None or cutter.at != key:
                if cutter is not None:
                    rows += cutter.finish()
                cutter = _Cutter(*key, *states[key])
            rows += cutter.rows(data)
            if len(rows) >= 2000:
                yield made()
        if cutter is not None:
            rows += cutter.finish()
        if rows:
            yield made()

    return run


def elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, section, text) of every object in the top-level arrays of the JSON files at path, and the files (file, depth, in_string) whose brackets
    or quotes don't close."""
    parts = _fragments(spark, path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = parts.mapInArrow(_summaries, "file string, block long, parity long, depth0 long, depth1 long").groupBy("file", "block").agg(*(F.sum(c).alias(c) for c in ("parity", "depth0", "depth1")))
    states = states.withColumn("inside", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).withColumn("change", F.when(F.col("inside") == 0, F.col("depth0")).otherwise(F.col("depth1")))
    states = materialize(states.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0))), "json_blocks")
    # one row a block of the size that Spark reads files in
    starts = spark.sparkContext.broadcast({(r["file"], r["block"]): (r["inside"] == 1, r["depth"]) for r in states.select("file", "block", "inside", "depth").toLocalIterator()})
    cut = materialize(parts.mapInArrow(_cut(starts), _CUT), "json_elements")

    marks = cut.where("piece = 'mark'")
    opened = marks.withColumn("opened", F.last("section", ignorenulls=True).over(before)).select("file", "block", "opened")
    whole = cut.where("piece = 'whole'")
    pieces = cut.where("piece in ('head', 'middle', 'tail')")
    upto = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("element", F.sum((F.col("piece") == "tail").cast("long")).over(upto))  # at most two rows a block
    joined = pieces.groupBy("file", "element").agg(F.min(F.when(F.col("piece") == "tail", F.col("block"))).alias("block"), F.max_by("section", F.col("piece") == "tail").alias("section"), F.array_sort(F.collect_list(F.struct("block", "n", "text"))).alias("t"))
    joined = joined.where("element > 0").select("file", "block", "section", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))
    found = whole.select("file", "block", "section", "text").unionByName(joined).join(F.broadcast(opened), ["file", "block"]).withColumn("section", F.coalesce("section", "opened"))
    ends = states.groupBy("file").agg(F.sum("change").alias("depth"), (F.sum("parity") % 2).alias("in_string"))
    # the reader's last fragment, behind the last brace, gets one too many
    return found.where(F.col("section") != _OBJECT).select("file", "section", "text"), ends
