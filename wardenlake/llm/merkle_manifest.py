"""A Merkle manifest of a dataset: leaves by document, one tree a group in the order of its keys, a tree over the groups, and proofs.

Leaves are hashed where the texts lie; what is shuffled is group, key and two digests. The rows are range-sorted into an RDD. A first pass counts each
task's rows of each group, and the counts of the tasks before are a row's place, so that a second pass knows which aligned subtrees lie whole in its
stretch and builds them there, each leaf with its siblings up to that subtree's top. The tops of ragged borders, at most two a level and task, are
shuffled by coordinate (group, place in blocks of 2 ** WIDTH leaves, then of 2 ** WIDTH such blocks, ...), which finishes the upper levels. Last, each leaf
meets the path of its top.

Both passes run on one RDD, whose borders are drawn once; a lost executor's stretch is sorted again by the same borders. What the driver sees is one row
a task and group. Memory: a task holds the digests of one group's stretch, ROWS_A_TASK rows on average.

Nulls and edges: a null column is hashed as `-`; the group of null comes first; rows with null keys come first in their group; rows that tie in group and
key are ordered by their leaf; equal rows are leaves of their own (in either order, as they have the same hash); rows with a null key or null
n_chars are never tampered with; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, materialize

ROWS_A_TASK = 100_000
WIDTH = 12
PATH = "array<struct<sibling: string, before: boolean>>"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    return (n - 1).bit_length()


def _field(c: Column) -> Column:
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """grp (lang with a mark, so that null is first), doc_id, leaf, forged (the leaf after tampering, null where nothing changes)."""
    before, after = [_field(F.col(c)) for c in ("doc_id", "source", "lang")], _field(F.col("text"))
    leaf = lambda n: F.sha2(F.concat(*before, _field(n), after), 256)
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), "doc_id", leaf(F.col("n_chars")).alias("leaf"), F.when(tampered, leaf(F.col("n_chars") + 1)).alias("forged"))


def _counts(pid: int, rows: Iterator) -> Iterator[tuple[str, int, int]]:
    n: dict[str, int] = {}
    for r in rows:
        n[r[0]] = n.get(r[0], 0) + 1
    return iter([(grp, pid, c) for grp, c in n.items()])


def _subtrees(start: int, hashes: list[str], total: int) -> tuple[list[tuple[int, list[str]]], list[tuple[int, int]]]:
    """Of leaves start, start + 1, ... among total: each level's first whole node and the nodes that are whole here; and of each leaf its top."""
    stop, levels = start + len(hashes), [(start, hashes)]
    for level in range(height(total)):
        first, nodes = levels[-1]
        end, size = first + len(nodes), (total + (1 << level) - 1) >> level
        a, b = (first + 1) // 2, (end + 1) // 2 if end == size else end // 2
        if b <= a:
            break
        levels.append((a, [H(*nodes[2 * i - first : min(2 * i + 2, end) - first]) for i in range(a, b)]))
    tops, at = [], start
    while at < stop:
        level = 0
        while level + 1 < len(levels) and levels[level + 1][0] <= at >> level + 1 < levels[level + 1][0] + len(levels[level + 1][1]):
            level += 1
        tops.append((level, at >> level))
        at = (at >> level) + 1 << level
    return levels, tops


def _build(offsets: dict[str, tuple[list[int], list[int], int]]):
    """The second pass: a row a leaf (with its top, its siblings below that, the top as folded from the forged leaf), and a row a top."""

    def run(pid: int, rows: Iterator) -> Iterator[tuple]:
        grp, held = None, []

        def finish() -> Iterator[tuple]:
            pids, starts, total = offsets[grp]
            start = starts[bisect_right(pids, pid) - 1]
            levels, tops = _subtrees(start, [r[1] for r in held], total)
            for level, pos in tops:
                yield grp, None, None, level, pos, total, levels[level][1][pos - levels[level][0]], None
                for i in range(pos << level, min(pos + 1 << level, start + len(held))):
                    doc_id, leaf, forged = held[i - start]
                    folded, siblings, p = forged or leaf, [], i
                    for first, nodes in levels[:level]:
                        s = p ^ 1
                        if s - first < len(nodes):
                            siblings.append(nodes[s - first])
                            folded = H(nodes[s - first], folded) if s < p else H(folded, nodes[s - first])
                        else:  # alone at its level's end
                            folded = H(folded)
                        p >>= 1
                    yield grp, doc_id, leaf, level, pos, total, folded, bytes.fromhex("".join(siblings))

        for r in rows:
            if r[0] != grp:
                if held:
                    yield from finish()
                grp, held = r[0], []
            held.append((r[1], r[2], r[3]))
        if held:
            yield from finish()

    return run


def _block(bottom: int):
    """Within one block: its nodes at many levels become the one node of its own level, each with its path up to there."""

    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        total = int(nodes["total"].iloc[0])
        upper = min(bottom, height(total))
        levels: list[dict[int, str]] = [{} for _ in range(upper + 1)]
        for level, pos, node in zip(nodes["level"], nodes["pos"], nodes["node"], strict=True):
            levels[level][pos] = node
        for level in range(upper):
            for pos in sorted({p >> 1 for p in levels[level]}):
                levels[level + 1][pos] = H(*(levels[level][p] for p in (2 * pos, 2 * pos + 1) if p in levels[level]))
        [(top, node)] = levels[upper].items()
        paths = []
        for level, p in zip(nodes["level"].tolist(), nodes["pos"].tolist(), strict=True):
            path = []
            for k in range(level, upper):
                path.append({"sibling": levels[k].get(p ^ 1), "before": bool(p & 1)})
                p >>= 1
            paths.append(path)
        out = nodes[["grp", "level", "pos", "total"]].copy()
        return out.assign(path=paths, up_level=upper, up_pos=top, up_node=node)

    return run


def climb(tops: DataFrame, width: int = WIDTH) -> DataFrame:
    """grp, level, pos, path (siblings up to the root of grp's tree, null where a node is alone), root. Tops cover their tree's leaves once."""
    rounds = -(-height(tops.agg(F.max("total")).first()[0] or 1) // width) or 1
    live = tops.select("grp", "level", "pos", "total", "node")
    found = live.select("grp", "level", "pos", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("level").alias("at"), F.col("pos").alias("at_pos"), F.col("node").alias("at_node"))
    for bottom in range(width, rounds * width + 1, width):
        here = live.where(F.col("level") <= bottom).withColumn("block", F.expr(f"shiftright(pos, int({bottom} - level))"))
        made = here.groupBy("grp", "block").applyInPandas(_block(bottom), f"grp string, level int, pos long, total long, path {PATH}, up_level int, up_pos long, up_node string")
        made = materialize(made, "manifest_level")
        more = made.select("grp", F.col("level").alias("at"), F.col("pos").alias("at_pos"), F.col("path").alias("more"), "up_level", "up_pos", "up_node")
        # tops above this round's blocks wait
        found = found.join(more, ["grp", "at", "at_pos"], "left").select(
            "grp", "level", "pos", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"),
            *(F.coalesce(new, old).alias(old) for new, old in (("up_level", "at"), ("up_pos", "at_pos"), ("up_node", "at_node"))),
        )
        above = live.where(F.col("level") > bottom)
        live = made.select("grp", F.col("up_level").alias("level"), F.col("up_pos").alias("pos"), "total", F.col("up_node").alias("node")).distinct().unionByName(above)
    return found.select("grp", "level", "pos", "path", F.col("at_node").alias("root"))


def fold(start: Column, path: Column) -> Column:
    """The root that a node and its siblings give; a null sibling stands for a node alone."""
    step = lambda h, s: F.sha2(F.when(s["before"], F.concat(s["sibling"], h)).otherwise(F.concat(h, F.coalesce(s["sibling"], F.lit("")))), 256)
    return F.aggregate(path, start, step)


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: s["sibling"]), "")


def manifest(docs: DataFrame, tasks: int | None = None, width: int = WIDTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row a document."""
    spark = docs.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS_A_TASK))
    ordered = leaves(docs).repartitionByRange(tasks, "grp", "doc_id", "leaf").sortWithinPartitions("grp", "doc_id", "leaf").rdd
    offsets: dict[str, tuple[list[int], list[int], int]] = {}
    for grp, pid, n in sorted(ordered.mapPartitionsWithIndex(_counts).collect()):  # one row a task and group
        pids, starts, total = offsets.get(grp, ([], [], 0))
        offsets[grp] = ([*pids, pid], [*starts, total], total + n)
    built = spark.createDataFrame(
        ordered.mapPartitionsWithIndex(_build(offsets)), "grp string, doc_id long, leaf string, level int, pos long, total long, node string, siblings binary", verifySchema=False
    )
    built = materialize(built, "manifest_leaves")
    paths = climb(built.where("leaf is null"), width)
    # the groups' roots are the leaves of one more tree
    roots = paths.groupBy("grp").agg(F.first("root").alias("node"))
    roots = roots.withColumn("pos", F.row_number().over(Window.orderBy("grp")).cast("long") - 1)  # one row a group
    groups = climb(roots.select(F.lit("").alias("grp"), F.lit(0).alias("level"), "pos", F.lit(len(offsets)).cast("long").alias("total"), "node"), width)
    groups = roots.select("grp", "pos").join(groups.select("pos", F.col("path").alias("over"), F.col("root").alias("all")), "pos").drop("pos")
    paths = materialize(paths.join(groups, "grp").select("grp", "level", "pos", F.concat("path", "over").alias("path"), F.col("root").alias("subroot"), F.col("all").alias("root")), "manifest_paths")

    small = F.broadcast(paths) if paths.count() <= SMALL_ROWS else paths
    out = built.where("leaf is not null").join(small, ["grp", "level", "pos"])
    proof = F.sha2(F.concat(F.lower(F.hex("siblings")), siblings(F.col("path"))), 256)
    folded = fold(F.col("node"), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))
