"""Hash chains, Merkle trees and differences of snapshots."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.shared import materialize
from .ordered import carried, join_groups, ranges_for, ranked

GENESIS = "0" * 64


def build_chain(records: DataFrame, keys: Sequence[str], order: str, content: Column) -> DataFrame:
    """records with sequence_number, previous_hash and record_hash = sha256(previous hash | content), a chain for each value of keys.

    A record's hash needs the one before it, so a chain is a sequential pass: the shuffle brings each into one task, sorts it there (spilling where it
    must), and rows stream by with only the last hash held. A null content adds nothing to the hash."""
    body = next(f"body{i or ''}" for i in range(len(records.columns) + 1) if f"body{i or ''}" not in records.columns)
    others = [c for c in records.columns if c not in keys]
    ties = [c for c in others if "map<" not in dict(records.dtypes)[c]]  # maps have no order
    rows = records.select(*keys, *others, content.cast("string").alias(body))
    rows = (rows.repartition(*keys) if keys else rows.coalesce(1)).sortWithinPartitions(*keys, order, body, *ties)
    n_keys = len(keys)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last, at = None, GENESIS, 0
        for batch in batches:
            owners = zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True) if n_keys else [()] * batch.num_rows
            places, before, after = [], [], []
            for own, text in zip(owners, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if own != chain:
                    chain, last, at = own, GENESIS, 0
                places.append(at)
                before.append(last)
                last = hashlib.sha256((last if text is None else f"{last}|{text}").encode()).hexdigest()
                after.append(last)
                at += 1
            made = [pa.array(places, pa.int64()), *batch.columns[n_keys:-1], pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *made], names)

    names = [*keys, "sequence_number", *others, "previous_hash", "record_hash"]
    kept = {f.name: f for f in rows.schema.fields}
    schema = StructType([*(kept[c] for c in keys), StructField("sequence_number", LongType()), *(kept[c] for c in others), StructField("previous_hash", StringType()), StructField("record_hash", StringType())])
    return rows.mapInArrow(link, schema)


def verify_chain(records: DataFrame, keys: Sequence[str], content: Column | None = None, sequence: str = "sequence_number", nonce: str = "nonce", time: str | None = None, place: str | None = None, ranges: int | None = None) -> DataFrame:
    """records with codes, the failures of each: gaps and repeats in the sequence, repeated nonces and hashes, broken links, altered content, and what is
    missing (a null sequence, nonce or hash is a failure of its own and never a repeat); clock steps back are warnings.

    place: the order of storage (the sequence itself unless given), a number or a time; records without one come last. A null content adds nothing to a
    hash, as in build_chain. Chains of up to a million records are a window each. Beyond that a chain is cut into ranges: places are counted
    over the ranges, each range's first record gets its predecessor from the range before, and the first of each nonce, hash and number comes from an aggregation."""
    ranges = ranges_for(records, keys) if ranges is None else ranges
    place, order = place or sequence, F.col(place or sequence).cast("double")
    placed = records.withColumn("__order", F.coalesce(order, F.lit(float("inf"))))
    link = F.struct(F.col("record_hash").alias("hash"), *([F.col(time).alias("time")] if time else []))  # never null, so that a missing hash is carried too
    if ranges <= 1:
        w = Window.partitionBy(*keys).orderBy("__order", F.col(place).asc_nulls_last(), F.col("record_hash").asc_nulls_last())
        out = placed.withColumns({"__at": F.row_number().over(w).cast("long") - 1, "__before": F.lag(link).over(w)})
    else:
        out = ranked(placed, keys, "__order", "__at", ranges, [F.col(place).asc_nulls_last(), F.col("record_hash").asc_nulls_last()])
        out = carried(out, keys, "__at", {"__before": link}, ranges, with_own=False)
    repeated = {}
    for i, c in enumerate((sequence, nonce, "record_hash")):
        if ranges <= 1:
            repeated[c] = F.col(c).isNotNull() & (F.col("__at") > F.min("__at").over(Window.partitionBy(*keys, c)))
        else:
            firsts = out.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.min("__at").alias(f"__first{i}"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
            out = join_groups(out, firsts, [*keys, c], "left")
            repeated[c] = F.coalesce(F.col("__at") > F.col(f"__first{i}"), F.lit(False))
    expected = F.when(F.col("__before").isNull(), GENESIS).otherwise(F.col("__before.hash"))
    missing = F.col("record_hash").isNull() | F.col("previous_hash").isNull()
    codes = [
        F.when(F.col(sequence).isNull(), "MISSING_SEQUENCE").when(repeated[sequence], "DUPLICATE_SEQUENCE").when(F.col(sequence) > F.col("__at"), "SEQUENCE_GAP").when(F.col(sequence) < F.col("__at"), "SEQUENCE_VIOLATION"),
        F.when(F.col(nonce).isNull(), "MISSING_NONCE").when(repeated[nonce], "DUPLICATE_NONCE"), F.when(missing, "MISSING_HASH"), F.when(~F.col("previous_hash").eqNullSafe(expected), "BROKEN_CHAIN"),
        F.when(repeated["record_hash"], "DUPLICATE_RECORD"),
    ]
    if content is not None:
        codes.append(F.when(F.sha2(F.concat_ws("|", "previous_hash", content), 256) != F.col("record_hash"), "CONTENT_ALTERED"))
    out = out.withColumn("codes", F.array_compact(F.array(*codes)))
    if time is not None:
        out = out.withColumn("clock_step_back", F.coalesce(F.col(time) < F.col("__before.time"), F.lit(False)))
    return out.drop("__at", "__before", "__order", *(f"__first{i}" for i in range(3)))


def triage(verified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_failures, first_failed, class of tampering by the worst code of a chain."""
    x = verified.select(*keys, "sequence_number", F.explode("codes").alias("code"))
    has = lambda c: F.max(F.col("code") == c)
    kind = F.when(has("CONTENT_ALTERED") | has("MISSING_HASH"), "CONTENT_TAMPERING").when(has("DUPLICATE_NONCE") | has("DUPLICATE_RECORD"), "REPLAY").when(has("SEQUENCE_GAP"), "DELETION").when(has("DUPLICATE_SEQUENCE"), "INSERTION").otherwise("REORDERING")
    return x.groupBy(*keys).agg(F.count("*").alias("n_failures"), F.min("sequence_number").alias("first_failed"), kind.alias("kind"))


def sequence_gaps(records: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """keys, after, n_missing of every gap between neighbouring numbers."""
    w = Window.partitionBy(*keys).orderBy(sequence)
    out = records.select(*keys, sequence).distinct().withColumn("next", F.lead(sequence).over(w))
    return out.where(F.col("next") > F.col(sequence) + 1).select(*keys, F.col(sequence).alias("after"), (F.col("next") - F.col(sequence) - 1).alias("n_missing"))


def replays(records: DataFrame, keys: Sequence[str], nonce: str) -> DataFrame:
    return records.groupBy(*keys, nonce).agg(F.count("*").alias("n")).where("n > 1")


def leaf_hash(fingerprint: Column) -> Column:
    """RFC 6962: sha256(0x00 | fingerprint), hex to hex."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.unhex(fingerprint)), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def ordered_leaves(samples: DataFrame, path: str, fingerprint: str) -> DataFrame:
    """i (from 0, by the path's UTF-8 bytes), path, fingerprint, hash. The order is made in ranges, not in one task."""
    return ranked(samples.select(F.col(path).cast("string").alias("path"), F.col(fingerprint).alias("fingerprint")).withColumn("__k", F.conv(F.rpad(F.substring(F.hex(F.col("path").cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")), [], "__k", "i", ties=["path"]).select("i", "path", "fingerprint", leaf_hash(F.col("fingerprint")).alias("hash"))


def merkle_levels(leaves: DataFrame, join: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """level, i, hash of every node, leaves (i, hash) being level 0. Neighbours are hashed in pairs and a lone last one rises as it is,
    which gives RFC 6962's tree; join(left, right) gives another tree's nodes, right being null for a lone one. Each level halves the rows:
    one grouped aggregation a level."""
    join = join or (lambda left, right: F.coalesce(node_hash(left, right), left))
    level = materialize(leaves.select(F.lit(0).alias("level"), F.col("i").cast("long").alias("i"), "hash"), "merkle")
    out, n, k = level, level.count(), 0
    while n > 1:
        k += 1
        pair = level.groupBy(F.floor(F.col("i") / 2).alias("p")).agg(F.min(F.when(F.col("i") % 2 == 0, F.col("hash"))).alias("l"), F.min(F.when(F.col("i") % 2 == 1, F.col("hash"))).alias("r"))
        level = pair.select(F.lit(k).alias("level"), F.col("p").alias("i"), join(F.col("l"), F.col("r")).alias("hash"))
        n = (n + 1) // 2
        if n <= 1 or k % 4 == 0:
            level = materialize(level, "merkle")
        out = out.union(level)
    return out


def merkle_roots(leaves: DataFrame, keys: Sequence[str], bits: int = 10) -> DataFrame:
    """keys, n (leaves), root of each group of leaves (i from 0 without gaps, hash): RFC 6962's tree of every group at once. A round hashes aligned runs of 2^bits nodes, in an
    array each, up to one node, so that a group of any size is dealt by run; a million leaves take two rounds. The driver sees the size of the largest group."""
    nodes = materialize(leaves.select(*keys, "i", "hash"), "leaves").withColumn("n", F.lit(1).cast("long"))
    left = nodes.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    pairs = lambda a: F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int"))
    up = lambda a, _: F.transform(pairs(a), lambda j: F.coalesce(node_hash(F.get(a, 2 * j), F.get(a, 2 * j + 1)), F.get(a, 2 * j)))
    while True:
        run = nodes.groupBy(*keys, F.shiftright("i", bits).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "hash"))).alias("run"), F.sum("n").alias("n"))
        top = F.aggregate(F.sequence(F.lit(1), F.lit(bits)), F.col("run.hash"), up)
        nodes, left = run.select(*keys, "i", F.get(top, F.lit(0)).alias("hash"), "n"), -(-left >> bits)
        if left <= 1:
            return nodes.select(*keys, "n", F.col("hash").alias("root"))


def merkle_root(leaves: DataFrame) -> DataFrame:
    levels = merkle_levels(leaves)
    return levels.orderBy(F.col("level").desc()).limit(1).select("hash")


def graph_levels(hashes: DataFrame, digest: str) -> DataFrame:
    """level, i, hash of the graph's own tree: hex digests in order, a lone last one taken twice, sha256 over the joined hex strings."""
    number = F.conv(F.substring("hash", 1, 12), 16, 10).cast("double")
    leaves = ranked(hashes.select(F.col(digest).alias("hash")).withColumn("__k", number), [], "__k", "i", ties=["hash"]).select("i", "hash")
    return merkle_levels(leaves, lambda left, right: F.sha2(F.concat(left, F.coalesce(right, left)), 256))


def graph_root(hashes: DataFrame, digest: str) -> DataFrame:
    """hash: one row, the root; that of an empty graph is a fixed name's."""
    top = graph_levels(hashes, digest).agg(F.max_by("hash", "level").alias("hash"))
    return top.select(F.coalesce("hash", F.sha2(F.lit("empty_merkle_tree"), 256)).alias("hash"))


def inclusion_proofs(levels: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """i, proof: the siblings (level, hash, left) of each leaf (of chosen i only) on its way to the root: a join of numbers, level by level."""
    top = levels.agg(F.max("level")).first()[0] or 0
    leaves = levels.where("level = 0").select("i") if chosen is None else chosen.select("i")
    steps = leaves.select("i", F.explode(F.sequence(F.lit(0), F.lit(max(top - 1, 0)))).alias("level")) if top else leaves.select("i", F.lit(-1).alias("level"))
    at = F.floor(F.col("i") / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    steps = steps.withColumn("s", F.when(at % 2 == 0, at + 1).otherwise(at - 1)).withColumn("left", at % 2 == 1)
    met = steps.join(levels.select("level", F.col("i").alias("s"), "hash"), ["level", "s"], "left")
    return met.groupBy("i").agg(F.array_sort(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("level", "hash", "left")))).alias("proof"))


def verify_proof(leaf: Column, proof: Column, root: Column) -> Column:
    return F.aggregate(proof, leaf, lambda h, s: F.when(s["left"], node_hash(s["hash"], h)).otherwise(node_hash(h, s["hash"]))) == root


def joined_digests(members: DataFrame, keys: Sequence[str], member: str, separator: str = "") -> DataFrame:
    """keys, n, digest (sha256 of the group's members in byte order, joined). A group is sorted in its task, spilling where it must, and streams by."""
    rows = members.where(F.col(member).isNotNull()).select(*keys, F.col(member).cast("string").alias("__member"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "__member")
    n_keys, names = len(keys), [*keys, "n", "digest"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest, n, kinds = None, None, 0, None
        done: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = [*zip(*done, strict=True)]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns[:-2], kinds, strict=True)), pa.array(columns[-2], pa.int64()), pa.array(columns[-1], pa.string())], names)

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(n_keys)]
            for own, text in zip(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True), batch.column(n_keys).to_pylist(), strict=True):
                if digest is not None and own == group:
                    digest.update(f"{separator}{text}".encode())
                    n += 1
                    continue
                if digest is not None:
                    done.append((*group, n, digest.hexdigest()))
                group, digest, n = own, hashlib.sha256(text.encode()), 1
            if len(done) >= 5000:
                yield made()
                done.clear()
        if digest is not None:
            done.append((*group, n, digest.hexdigest()))
            yield made()

    kept = {f.name: f for f in rows.schema.fields}
    return rows.mapInArrow(stream, StructType([*(kept[k] for k in keys), StructField("n", LongType()), StructField("digest", StringType())]))


def ordered_set_hash(df: DataFrame, keys: Sequence[str], digest: Column) -> DataFrame:
    """keys, digest of the sorted member digests joined."""
    return joined_digests(df.withColumn("__digest", digest), keys, "__digest").drop("n")


def snapshot_diff(reference: DataFrame, candidate: DataFrame, name: str, meta: Sequence[str], content: str) -> DataFrame:
    """name, change of a full outer join by name: ADDED, REMOVED, CONTENT_CHANGED, METADATA_CHANGED, CONTENT_AND_METADATA_CHANGED, UNCHANGED."""
    a = reference.select(F.col(name).alias("name"), F.struct(*meta).alias("rm"), F.col(content).alias("rc"))
    b = candidate.select(F.col(name).alias("name"), F.struct(*meta).alias("cm"), F.col(content).alias("cc"))
    j = a.join(b, "name", "full_outer")
    m, c = ~F.col("rm").eqNullSafe(F.col("cm")), ~F.col("rc").eqNullSafe(F.col("cc"))
    change = F.when(F.col("rm").isNull(), "ADDED").when(F.col("cm").isNull(), "REMOVED").when(m & c, "CONTENT_AND_METADATA_CHANGED").when(c, "CONTENT_CHANGED").when(m, "METADATA_CHANGED").otherwise("UNCHANGED")
    return j.select("name", change.alias("change"))


def drift_class(structure: Column, weights: Column, contract: Column) -> Column:
    """From three booleans (null: could not be compared) one of eight states."""
    s, w, c = (F.coalesce(x, F.lit(False)) for x in (structure, weights, contract))
    none = structure.isNull() & weights.isNull() & contract.isNull()
    return (
        F.when(none, "DRIFT_UNAVAILABLE").when(~s & ~w & ~c, "EXACT_INTEGRITY_MATCH").when(~s & w & ~c, "WEIGHT_ONLY_DRIFT").when(s & ~w & ~c, "STRUCTURAL_ONLY_DRIFT").when(~s & ~w & c, "CONTRACT_ONLY_DRIFT")
        .when(s & w & ~c, "STRUCTURAL_AND_WEIGHT_DRIFT").when(s & ~w & c, "STRUCTURAL_AND_CONTRACT_DRIFT").when(~s & w & c, "WEIGHT_AND_CONTRACT_DRIFT").otherwise("STRUCTURAL_WEIGHT_CONTRACT_DRIFT")
    )
