"""The trie of conversations' turns: one row a distinct prefix, with members, children, leaves and the bytes that sharing the prefix saves.

Conversations are rebuilt first (the head of their family's first conversation, then their own turns), each as an array of turn digests (128 bits
of SHA-256 of role and text) whose concatenation is its sort key. The keys are range-sorted over all tasks, copies apart by conv_id. Each task
sweeps its sorted stretch with a stack: the common prefix with the row before (LCP) says which nodes close and which open. Only the paths of a task's
first and last conversation can go on in a neighbour; these open stacks are written with their partial sums and added up by prefix. What
two neighbours both counted (the path that the last and the next first conversation share) is taken off once a border, so that stitching is a few
joins and sums over tables that grow with the number of tasks times the turns of one conversation.

Memory: a task holds the nodes of its stretch that await their parent's close, at most those of ROWS_A_TASK turns on average; texts don't leave the scan.
A conversation is one array, 16 bytes a turn. The members that end at one node are hashed in order, so that a group of copies over many tasks passes
through one task as chunks of joined ids, streamed.

Nulls and edges: rows with a null conv_id belong to no conversation and are left out; null turns come first; turns that tie are ordered by their digest;
null role or text is empty; repeated rows are repeated turns; a conversation without turns left is a member of the root; an empty table has no nodes; further
columns are not read. `%` is SQL's remainder, so that -3 belongs to 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FAMILY, HEADS = 5, 9
ROWS_A_TASK = 200_000
WIDTH = 16
NONE_SHA256 = hashlib.sha256(b"").hexdigest()

RAW = pa.schema([
    ("pid", pa.int32()), ("local", pa.int64()), ("parent_local", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("weighted", pa.int64()), ("distinct", pa.int64()), ("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()),
    ("own", pa.int64()), ("path", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("ended", pa.bool_()), ("ends", pa.binary()),
])
RAW_DDL = (
    "pid int, local long, parent_local long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, weighted long, distinct long, ends_sha256 string, "
    "key binary, parent_key binary, own long, path long, first boolean, last boolean, ended boolean, ends binary"
)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, key (digests of its turns, concatenated), sizes (UTF-8 bytes of its texts). One shuffle, by family, of digests alone."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(
        F.expr(f"conv_id - conv_id % {FAMILY}").alias("base"), "conv_id",
        F.struct(F.col("turn").alias("turn"), F.substring(F.sha2(said, 256), 1, 2 * WIDTH).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")).alias("said"),
    )
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))  # nulls first
    heads = own.where("conv_id = base").select("base", F.slice("turns", 1, HEADS - 1).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    none = F.slice("turns", 1, 0)
    taken = F.when(h > 0, F.slice(F.coalesce("head", none), F.lit(1), h.cast("int"))).otherwise(none)
    both = own.join(heads, "base", "left").select("conv_id", F.concat(taken, F.slice("turns", (h + 1).cast("int"), F.size("turns"))).alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["n_bytes"]).alias("sizes"))


class _Node:
    __slots__ = ("local", "depth", "own", "first", "conv", "n", "kids", "leaves", "weighted", "distinct", "ends", "waiting")

    def __init__(self, local: int, depth: int, own: int, first: bool):
        self.local, self.depth, self.own, self.first = local, depth, own, first
        self.conv, self.n, self.kids, self.leaves, self.weighted, self.distinct = None, 0, 0, 0, 0, 0
        self.ends, self.waiting = [], []

    def take(self, child: _Node) -> None:
        self.conv = child.conv if self.conv is None else min(self.conv, child.conv)
        self.n += child.n
        self.kids += 1
        self.leaves += child.leaves
        self.weighted += child.weighted
        self.distinct += child.distinct

    def finish(self) -> None:
        self.leaves = self.leaves or 1
        self.weighted += self.n * self.own
        self.distinct += self.own


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    i = 0
    while a[i : i + WIDTH] == b[i : i + WIDTH]:
        i += WIDTH
    return i // WIDTH


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one sorted stretch. Those on its first or last path come with a key and partial sums; a node under such a one names it by parent_local."""
    pid, rows = TaskContext.get().partitionId(), []
    stack: list[_Node] = []
    made, seen = 0, b""

    def row(node: _Node, parent_local=None, parent_conv=None) -> list:
        joined = ",".join(map(str, node.ends)).encode()
        return [pid, node.local, parent_local, node.conv, node.depth, parent_conv, node.n, node.kids, node.leaves, node.weighted, node.distinct, hashlib.sha256(joined).hexdigest(), None, None, None, None, False, False, False, None]

    def close(last: bool) -> None:
        """Take the topmost node off. Its children can be told their parent's least member now, its own row waits for the parent's close."""
        nonlocal path
        node = stack.pop()
        node.finish()
        if node.first or last:
            for child in node.waiting:
                rows.append(row(child, node.local))
            key, above = keys[node.depth], keys[node.depth - 1] if node.depth else None
            ends = ",".join(map(str, node.ends)).encode() if node.ends else None
            rows.append([pid, node.local, None, node.conv, node.depth, None, node.n, node.kids, node.leaves, node.weighted, node.distinct, None, key, above, node.own, path[node.depth], node.first, last, last and node.depth * WIDTH == len(seen), ends])
        else:
            for child in node.waiting:
                rows.append(row(child, None, node.conv))
        node.waiting = []
        if stack:
            stack[-1].take(node)
            if not (node.first or last):
                if stack[-1].first:
                    rows.append(row(node, stack[-1].local))
                else:
                    stack[-1].waiting.append(node)

    def digests(sequence: bytes) -> list[bytes]:
        out, h = [hashlib.sha256(b"").digest()[:WIDTH]], hashlib.sha256()
        for i in range(0, len(sequence), WIDTH):
            h.update(sequence[i : i + WIDTH])
            out.append(h.digest()[:WIDTH])
        return out

    keys, path = [], []
    for batch in batches:
        for conv, key, sizes in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "key", "sizes")), strict=True):
            starts = not stack
            if starts:
                stack.append(_Node(made, 0, 0, True))
                made, keys, path = made + 1, digests(key), [0]
                for size in sizes:
                    path.append(path[-1] + size)
            shared = _common(seen, key)
            while len(stack) - 1 > shared:
                close(False)
            for depth in range(len(stack), len(key) // WIDTH + 1):
                stack.append(_Node(made, depth, sizes[depth - 1], starts))
                made += 1
            top = stack[-1]
            top.n += 1
            top.conv = conv if top.conv is None else min(top.conv, conv)
            top.ends.append(conv)
            seen = key
        while len(rows) >= 5000:
            yield _batch(rows[:5000])
            del rows[:5000]
    if stack:  # the last path: it may go on in the next stretch
        keys, path = digests(seen), [0]
        for node in stack[1:]:
            path.append(path[-1] + node.own)
        while stack:
            close(True)
    for i in range(0, len(rows), 5000):
        yield _batch(rows[i : i + 5000])


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RAW, strict=True)], schema=RAW)


def _hash_chunks(rows: Iterator) -> Iterator[tuple]:
    """Rows sorted by key and task: the chunks of one key are hashed as they stream by."""
    key = h = None
    for r in rows:
        if key != bytes(r["key"]):
            if key is not None:
                yield key, h.hexdigest()
            key, h = bytes(r["key"]), hashlib.sha256(r["ends"])
        else:
            h.update(b"," + r["ends"])
    if key is not None:
        yield key, h.hexdigest()


def trie(conversations: DataFrame, tasks: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node."""
    spark = conversations.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-conversations.count() // ROWS_A_TASK))
    ordered = rebuilt(conversations).repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    raw = materialize(ordered.mapInArrow(sweep, RAW_DDL), "trie_nodes")
    open_, closed = raw.where("key is not null"), raw.where("key is null")

    # the path that the last conversation of a stretch shares with the first of the next was counted in both
    following = open_.where("depth = 0").select("pid", F.lead("pid").over(Window.orderBy("pid")).alias("next_pid"))  # one row a task
    firsts = open_.where("first").select(F.col("pid").alias("next_pid"), "depth", "key")
    border = Window.partitionBy("pid")
    shared = open_.where("last").join(following, "pid").join(firsts, ["next_pid", "depth", "key"]).withColumns({"deepest": F.max("depth").over(border), "whole": F.max("path").over(border), "leaf": F.max("ended").over(border)})
    sums = ["n_convs", "n_children", "n_leaves", "weighted", "distinct"]
    twice = shared.select(
        "key", "parent_key", "depth", F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n_convs"), (-(F.col("depth") < F.col("deepest")).cast("long")).alias("n_children"),
        (-F.col("leaf").cast("long")).alias("n_leaves"), F.lit(0).cast("long").alias("weighted"), (F.col("path") - F.col("own") - F.col("whole")).alias("distinct"),
    )
    parts = open_.select("key", "parent_key", "depth", "conv_id", *sums).unionByName(twice)
    stitched = parts.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums))
    chunks = open_.where("ends is not null").select("key", "pid", "ends").repartition(tasks, "key").sortWithinPartitions("key", "pid")
    ends = spark.createDataFrame(chunks.rdd.mapPartitions(_hash_chunks), "key binary, ends_sha256 string", verifySchema=False)
    stitched = materialize(stitched.join(ends, "key", "left"), "trie_stitched")

    members = stitched.select("key", F.col("conv_id").alias("parent_conv_id"))
    named = open_.select("pid", F.col("local").alias("parent_local"), "key").join(members, "key").drop("key")
    saved = (F.col("weighted") - F.col("distinct")).alias("saved_tokens")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, F.coalesce("ends_sha256", F.lit(NONE_SHA256)).alias("ends_sha256")]
    inside = closed.where("parent_local is null").select(*columns)
    below = closed.where("parent_local is not null").drop("parent_conv_id").join(named, ["pid", "parent_local"]).select(*columns)
    above = stitched.join(members.withColumnRenamed("key", "parent_key"), "parent_key", "left").select(*columns)
    return inside.unionByName(below).unionByName(above)
