"""Near-duplicates by b-bit MinHash: bands of full minima propose, packed low bits estimate, whole texts confirm.

1. One pass over the texts gives each document its node (a digest of its words), 32 band keys of 4 full minima each and 128
   four-bit remainders packed into 8 longs. Documents with the same words are one node, however many they are. A node's name
   begins with its least doc_id, so names order as the ids do and the least name of a component holds the component's id.
2. In each band bucket the least name is the hub. A node proposes the hub whose packed signature agrees best (bit counts,
   corrected for the chance agreement of 2**-b); the pair is confirmed on the whole texts. This costs one pair a node.
3. Buckets that still hold nodes of different components go to blocks of bounded size: members outside the bucket's largest
   component meet each other and those inside it, signatures alone; pairs whose estimate could reach the threshold are confirmed
   as in 2. A block with more such pairs than MANY a node isn't listed: its texts meet in smaller blocks, where only links that join
   two components leave the task. So every pair that shares a bucket is linked, already joined or refuted.
4. Components by alternating large-star and small-star steps; nothing is gathered on the driver.

Confirming numbers the words of both texts and compares the sets of runs of numbers: no hash takes part. A pair at similarity 0.85 (0.8) shares
no bucket with probability 6e-11 (5e-8). Nothing is capped or dropped.

Nulls and edges: a null or wordless text has an empty set, is linked with nothing and stands alone; with fewer words than k
the whole sequence is the one shingle; a null doc_id can be linked but is never the least id (a component of null ids has a
null component_id and is kept); ties of estimates go to the greatest name; repeated rows each get their row; further columns
don't matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, flat, materialize, mix, shingle_sets, slices, text_bytes

PERMUTATIONS, ROWS, BITS = 128, 4, 4
BLOCK, PARTS, MANY = 512, 4, 8  # nodes of a block's side; blocks of texts are PARTS times smaller; pairs a node that are listed
SALT = 64
_rng = np.random.default_rng(712)
_A = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """PERMUTATIONS minima of each set, 32 bits wide; an empty set's are all ones."""
    out = np.full((len(sets), PERMUTATIONS), 0xFFFFFFFF, np.uint64)
    for row, s in zip(out, sets, strict=True):
        for at in range(0, len(s), 4096):
            np.minimum(row, ((s[None, at : at + 4096] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(1), out=row)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    x = m.reshape(len(m), PERMUTATIONS // ROWS, ROWS)
    h = np.broadcast_to(mix(np.arange(1, PERMUTATIONS // ROWS + 1, dtype=np.uint64)), x.shape[:2])
    for j in range(ROWS):
        h = mix(h * np.uint64(0xA0761D6478BD642F) + x[:, :, j])
    return h.astype(np.int64)


def pack(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, 64 // BITS to a word."""
    per = 64 // BITS
    low = (m & np.uint64((1 << BITS) - 1)).reshape(len(m), PERMUTATIONS // per, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2).astype(np.int64)


_LOW = sum(1 << (BITS * i) for i in range(64 // BITS))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (last axis: words): agreement by bit counts, corrected for chance collisions."""
    x = (a ^ b).view(np.uint64)
    for s in (1, 2):
        x = x | (x >> np.uint64(s))
    differ = np.bitwise_count(x & np.uint64(_LOW)).sum(-1, dtype=np.int64)
    chance = 2.0**-BITS
    return ((PERMUTATIONS - differ) / PERMUTATIONS - chance) / (1 - chance)


def estimate_column(a: str, b: str):
    """The same on array<long> columns."""
    differ = F.lit(0)
    for i in range(PERMUTATIONS * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for s in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(_LOW).cast("long")))
    chance = 2.0**-BITS
    return ((F.lit(PERMUTATIONS) - differ) / F.lit(PERMUTATIONS) - F.lit(chance)) / F.lit(1 - chance)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z, and the six ASCII spaces


def node_of(words: list[bytes]) -> bytes | None:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def similar(a: list[bytes], b: list[bytes], k: int, percent: int) -> bool:
    """Whether 100 * |A and B| >= percent * |A or B| for the sets of runs of k words, by the words themselves."""
    if len(a) < k or len(b) < k:  # a shorter sequence is one shingle, which no longer run equals
        return a == b
    number: dict[bytes, int] = {}
    one = np.array([number.setdefault(w, len(number)) for ws in (a, b) for w in ws], np.int64)
    runs, reach = one, len(number)
    for j in range(1, k):
        if reach * len(number) >= 1 << 62:
            runs = np.unique(runs, return_inverse=True)[1]
            reach = len(runs)
        runs, reach = runs[:-1] * len(number) + one[j:], reach * len(number)
    x, y = np.unique(runs[: len(a) - k + 1]), np.unique(runs[len(a) :])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "b"):
            text = part.column(part.schema.get_field_index("b"))
            sets, nodes = shingle_sets(*flat(text), k), [node_of(words_of(x)) for x in text.to_pylist()]
            m = minima(sets)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (band_keys(m), pack(m))]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *lists], ["doc_id", "node", "n_shingles", "keys", "sig"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "b"):
        text = part.column(part.schema.get_field_index("b"))
        yield pa.RecordBatch.from_arrays([pa.array([node_of(words_of(x)) for x in text.to_pylist()], pa.binary()), text], ["node", "b"])


def _confirm(k: int, percent: int):
    """Rows (a, b, ta, tb): those that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[bytes]] = {}  # hubs come often

        def of(node: bytes, text: pa.Scalar) -> list[bytes]:
            if node not in held:
                if len(held) > 100:
                    held.clear()
                held[node] = words_of(text.as_py())
            return held[node]

        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            out = pa.array([i for i in range(len(batch)) if similar(words_of(ta[i].as_py()), of(b[i].as_py(), tb[i]), k, percent)], pa.int32())
            yield pa.RecordBatch.from_arrays([a.take(out), b.take(out)], ["a", "b"])

    return run


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(n, -1)


def _near(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For the rows of one side of a block: the rows of the other side (alone: the later rows) of other components whose estimate allows the threshold."""
    floor = percent / 100 - 6.5 * np.sqrt(percent / 100 * (1 - percent / 100) / PERMUTATIONS)
    n = table.num_rows
    keys, sig = _matrix(table["keys"], n), _matrix(table["sig"], n)
    number: dict[bytes, int] = {}
    comp = np.array([number.setdefault(c, len(number)) for c in table["comp"].to_pylist()])
    right, alone = np.array(table["right"].to_pylist(), bool), table["alone"][0].as_py()
    band = int(np.flatnonzero(keys[0] == table["key"][0].as_py())[0])
    other = np.flatnonzero(right)
    for i in range(n) if alone else np.flatnonzero(~right).tolist():
        to = np.arange(i + 1, n) if alone else other
        near = (estimate(sig[i][None, :], sig[to]) >= floor) & (comp[to] != comp[i])
        if band and near.any():
            near &= ~(keys[to, :band] == keys[i, :band]).any(1)  # that pair is another bucket's
        if near.any():
            yield i, to[near]


def _screen(percent: int):
    """One block: the pairs that are to be confirmed; or, if they are too many to be listed, the block's own place."""

    def run(table: pa.Table) -> pa.Table:
        node, a, b, dense = table["node"].to_pylist(), [], [], False
        for i, js in _near(table, percent):
            a += [node[i]] * len(js)
            b += [node[j] for j in js.tolist()]
            if dense := len(a) > MANY * len(node):
                break
        if dense:
            place = {c: pa.array([table[c][0].as_py()], t) for c, t in (("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()))}
            return pa.table({"a": pa.nulls(1, pa.binary()), "b": pa.nulls(1, pa.binary()), **place})
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "key": pa.nulls(len(a), pa.int64()), "lo": pa.nulls(len(a), pa.int32()), "hi": pa.nulls(len(a), pa.int32())})

    return run


def _join_block(k: int, percent: int):
    """One block of texts: links that join components."""

    def run(table: pa.Table) -> pa.Table:
        node, comp, texts = table["node"].to_pylist(), table["comp"].to_pylist(), table["b"].combine_chunks()
        first: dict[bytes, int] = {}
        boss = [first.setdefault(c, i) for i, c in enumerate(comp)]
        words: dict[int, list[bytes]] = {}

        def top(i: int) -> int:
            while boss[i] != i:
                boss[i] = boss[boss[i]]
                i = boss[i]
            return i

        def of(i: int) -> list[bytes]:
            if i not in words:
                words[i] = words_of(texts[i].as_py())
            return words[i]

        links = []
        for i, js in _near(table, percent):
            for j in js.tolist():
                p, q = top(i), top(j)
                if p != q and similar(of(i), of(j), k, percent):
                    boss[q] = p
                    links.append((node[i], node[j]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    return run


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows (node, root) for every node of the links (a, b); root is the least node of its component. Large-star and small-star in turn.
    rows: about how many links there are, if known."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    mark = None
    while True:
        # a hub's edges are SALT keys, so that no task has them all; each key's least node, then the hub's, meets them
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)))
        part = both.groupBy("a", "salt").agg(F.min("b").alias("m"))
        least = part.select("a", "salt").join(part.groupBy("a").agg(F.least(F.min("m"), F.first("a")).alias("m")), "a")
        large = both.where("b > a").join(least, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, materialize(small, "edges", mark[0] if mark else rows)
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _name() -> Column:
    """A node's name: its least doc_id (null after all others) in bytes that order as the ids do, then its digest."""
    place = F.when(F.col("doc_id").isNull(), F.lit("01" + "F" * 16)).otherwise(F.concat(F.lit("00"), F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))
    return F.concat(F.unhex(place), F.col("node"))


def _id_of(name: Column) -> Column:
    high = F.conv(F.hex(F.substring(name, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(name, 1, 1)) == "00", high.cast("long"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text): documents are linked where 100 * |A and B| >= percent * |A or B|."""
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("b"))
    sketch = materialize(source.mapInArrow(_sketch(k), "doc_id long, node binary, n_shingles long, keys array<long>, sig array<long>"), "sketch")
    nodes = sketch.where("node is not null").groupBy("node").agg(F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id"))
    nodes = materialize(nodes.select(F.col("node").alias("digest"), _name().alias("node"), "keys", "sig"), "nodes")

    member = nodes.select("node", F.explode("keys").alias("key"))
    bucket = member.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("hub")).where("m > 1")
    shared = materialize(member.join(bucket, "key").select("key", "hub", "node"), "shared")
    in_any = nodes.select("digest", "node").join(shared.select("node").distinct(), "node", "left_semi")
    # a task's copies become one row before the shuffle, however hot their group is
    named = source.mapInArrow(_named, "node binary, b binary").where("node is not null").groupBy(F.col("node").alias("digest")).agg(F.first("b").alias("b"))
    texts = materialize(named.join(in_any, "digest").select("node", "b"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("b").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("b").alias("tb")), "b")
        return materialize(both.select("a", "b", "ta", "tb").mapInArrow(_confirm(k, percent), "a binary, b binary"), "links")

    sig = nodes.select("node", "sig")
    best = (
        shared.where("hub <> node").select("node", "hub").distinct()
        .join(sig, "node").join(sig.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
        .withColumn("est", estimate_column("sig", "hub_sig"))
        .groupBy("node").agg(F.max(F.struct("est", "hub")).alias("x")).select(F.col("node").alias("a"), F.col("x.hub").alias("b"))
    )
    stars = confirmed(best)
    n = nodes.count()
    joined = materialize(components(stars, n), "joined", n)

    marked = shared.select("key", "node").join(joined, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    sizes = marked.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    mixed = mixed.select("key", F.col("top.comp").alias("inside"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("ni"), F.ceil((F.col("m") - F.col("top.c")) / BLOCK).cast("int").alias("no"))
    place = F.pmod(F.xxhash64("node", "key"), F.when(F.col("outside"), F.col("no")).otherwise(F.col("ni"))).cast("int")
    # blocks of outsiders are 0 .. no-1, of insiders no .. no+ni-1; a task holds an outsider block and another block, or one outsider block with itself
    others = F.when(F.col("outside"), F.sequence(F.lit(0), F.col("no") + F.col("ni") - 1)).otherwise(F.sequence(F.lit(0), F.col("no") - 1))
    blocks = (
        marked.join(mixed, "key").withColumn("outside", F.col("comp") != F.col("inside"))
        .withColumn("half", place + F.when(F.col("outside"), 0).otherwise(F.col("no")))
        .withColumn("other", F.explode(others)).withColumn("lo", F.least("half", "other")).withColumn("hi", F.greatest("half", "other"))
        .select("key", "node", "comp", "lo", "hi", (F.col("half") == F.col("hi")).alias("right"), (F.col("lo") == F.col("hi")).alias("alone"))
    )
    signed = blocks.join(nodes.select("node", "keys", "sig"), "node")
    screened = materialize(signed.groupBy("key", "lo", "hi").applyInArrow(_screen(percent), "a binary, b binary, key long, lo int, hi int"), "screened")
    links = stars.union(confirmed(screened.where("a is not null").select("a", "b").distinct()))
    dense = screened.where("a is null").select("key", "lo", "hi")
    if not dense.isEmpty():
        part, every = F.pmod(F.xxhash64("node", "key", F.lit(1)), F.lit(PARTS)).cast("int"), F.sequence(F.lit(0), F.lit(PARTS - 1))
        x = F.when(F.col("alone"), F.least("part", "more")).otherwise(F.when(F.col("right"), F.col("more")).otherwise(F.col("part")))
        y = F.when(F.col("alone"), F.greatest("part", "more")).otherwise(F.when(F.col("right"), F.col("part")).otherwise(F.col("more")))
        finer = signed.join(dense, ["key", "lo", "hi"], "left_semi").withColumn("part", part).withColumn("more", F.explode(every)).withColumn("x", x).withColumn("y", y)
        finer = finer.withColumn("right", F.when(F.col("alone"), F.col("part") == F.col("y")).otherwise(F.col("right"))).withColumn("alone", F.col("alone") & (F.col("x") == F.col("y")))
        links = links.union(finer.drop("part", "more").join(texts, "node").groupBy("key", "lo", "hi", "x", "y").applyInArrow(_join_block(k, percent), "a binary, b binary"))

    # the least name of a component holds its id: no join by component, whose key a large one would make hot
    of_node = components(links, n).select(F.substring("node", 10, 16).alias("node"), _id_of(F.col("root")).alias("component_id"))
    alone = nodes.join(of_node.select(F.col("node").alias("digest")), "digest", "left_anti").select(F.col("digest").alias("node"), _id_of(F.col("node")).alias("component_id"))
    of_node = materialize(of_node.union(alone), "components", n)  # then both sides of the last join are plain shuffles, and a hot group of copies can be split
    done = sketch.select("doc_id", "node", "n_shingles").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return done.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
