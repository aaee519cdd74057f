"""Near-duplicates by 64-bit hashes. A hash is a BIGINT bit pattern; distances are bit counts."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import discard, materialize
from .integrity import joined_digests


def from_hex(x: Column) -> Column:
    """The bit pattern of sixteen hex digits, from two halves (unsigned 64 bits overflow a BIGINT)."""
    half = lambda s: F.conv(s, 16, 10).cast("bigint")
    return F.shiftleft(half(F.substring(x, 1, 8)), 32).bitwiseOR(half(F.substring(x, 9, 8)))


def to_hex(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(vector: Column) -> Column:
    """One bit for each of 64 components: whether it is positive, the first one lowest."""
    return F.aggregate(F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def _plan(radius: int, tables: int) -> list[tuple[int, int, int]]:
    """start, width, reach of each table's stretch of the 64 bits. Two hashes within radius differ by at most reach on one stretch: with radius =
    tables * a + b, either one of the first b + 1 stretches has at most a differences, or one of the others at most a - 1."""
    edges = [64 * i // tables for i in range(tables + 1)]
    a, b = divmod(radius, tables)
    return [(s, e - s, a if i <= b else a - 1) for i, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if i <= b or a > 0]


def _ball(width: int, reach: int) -> int:
    return sum(math.comb(width, k) for k in range(min(reach, width) + 1))


def index_plan(radius: int, n: int) -> list[tuple[int, int, int]]:
    """Of the plans with 2 to 16 tables the cheapest for n hashes: probed keys plus pairs of random hashes that meet. More hashes make longer keys."""
    cost = lambda plan: n * sum(_ball(w, r) for _, w, r in plan) + n * n / 2 * sum(_ball(w, r) / 2**w for _, w, r in plan)
    return min((_plan(radius, t) for t in range(2, 17)), key=cost)


def _stretch(h: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(h, 64 - start - width), 64 - width)


def near_classes(classes: DataFrame, radius: int, plan: list[tuple[int, int, int]] | None = None, candidates: bool = False) -> DataFrame:
    """h, g (h < g), all pairs of the distinct hashes in column h within radius, by multi-index hashing: each table holds the hashes by one stretch of bits,
    and each hash probes all keys within the table's reach of its own. Which table finds a pair first is told by the pair itself, so that none comes
    twice and nothing is made distinct. candidates: the pairs that meet, before the bit count. plan: see index_plan, by default for the counted hashes."""
    spark = classes.sparkSession
    plan = plan or index_plan(radius, max(classes.count(), 2))
    masks = [(i, sum(1 << k for k in bits)) for i, (_, width, reach) in enumerate(plan) for size in range(min(reach, width) + 1) for bits in itertools.combinations(range(width), size)]
    masks = F.broadcast(spark.createDataFrame(masks, "band int, mask long"))  # as many as the plan says, whatever the table's size
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), _stretch(F.col("h"), s, w).alias("key")) for i, (s, w, _) in enumerate(plan))))
    held = classes.select("h", keys.alias("k")).select(F.col("h").alias("g"), "k.band", "k.key")
    probes = classes.select("h", keys.alias("k")).select("h", "k.band", "k.key").join(masks, "band").select("h", "band", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    met = probes.join(held, ["band", "key"]).where("h < g")
    apart = F.col("h").bitwiseXOR(F.col("g"))
    first = F.coalesce(*(F.when(F.bit_count(_stretch(apart, s, w)) <= reach, F.lit(i)) for i, (s, w, reach) in enumerate(plan)))
    met = met.where(F.col("band") == first)
    return (met if candidates else met.where(F.bit_count(apart) <= radius)).select("h", "g")


def pairs_within(hashes: DataFrame, sample_id: str, column: str, radius: int) -> DataFrame:
    """a, b (a < b), distance of all pairs within radius. Equal hashes are one class: classes meet in the index, then expand to pairs, which the caller
    asked for; groups need no pairs (duplicate_groups). Null hashes are near nothing."""
    classes = hashes.where(F.col(column).isNotNull()).select(F.col(column).alias("h")).distinct()
    near = near_classes(classes, radius).union(classes.select("h", F.col("h").alias("g")))
    left, right = (hashes.select(F.col(sample_id).alias(i), F.col(column).alias(c)) for i, c in (("i", "h"), ("j", "g")))
    met = near.join(left, "h").join(right, "g").where(F.col("i") != F.col("j"))
    return met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), hamming(F.col("h"), F.col("g")).alias("distance")).distinct()


def relationships(prints: DataFrame, sample_id: str = "sample_id", strategy: str = "both", p_radius: int = 10, d_radius: int = 10, p_weight: float = 0.6, d_weight: float = 0.4, least: float = 0.84) -> DataFrame:
    """a, b, p_distance, d_distance, similarity, exact for prints (sample_id, phash, dhash as BIGINT). both and any take the radii, weighted a
    least similarity; any looks in both hashes, so that no pair is missed that is near in one alone."""
    if strategy == "both":
        candidates = pairs_within(prints, sample_id, "phash", p_radius).select("a", "b")
    elif strategy == "any":
        candidates = pairs_within(prints, sample_id, "phash", p_radius).select("a", "b").union(pairs_within(prints, sample_id, "dhash", d_radius).select("a", "b")).distinct()
    elif strategy == "weighted":
        # if both distances were beyond this reach, their weighted mean would be too
        reach = max(0, min(int(64 * (1 - least) / (p_weight + d_weight) + 1e-9), 63))
        candidates = pairs_within(prints, sample_id, "phash", reach).select("a", "b").union(pairs_within(prints, sample_id, "dhash", reach).select("a", "b")).distinct()
    else:
        raise ValueError("strategy must be both, any or weighted")
    x, y = (prints.select(F.col(sample_id).alias(i), F.col("phash").alias(f"p{i}"), F.col("dhash").alias(f"d{i}")) for i in ("a", "b"))
    out = candidates.join(x, "a").join(y, "b").withColumn("p_distance", hamming(F.col("pa"), F.col("pb"))).withColumn("d_distance", hamming(F.col("da"), F.col("db")))
    out = out.withColumn("similarity", F.bround(p_weight * (1 - F.col("p_distance") / 64) + d_weight * (1 - F.col("d_distance") / 64), 4))
    p_ok, d_ok = F.col("p_distance") <= p_radius, F.col("d_distance") <= d_radius
    keep = {"both": p_ok & d_ok, "any": p_ok | d_ok, "weighted": F.col("similarity") >= least}[strategy]
    return out.where(keep).select("a", "b", "p_distance", "d_distance", "similarity", ((F.col("p_distance") == 0) & (F.col("d_distance") == 0)).alias("exact"))


def _star(prints: DataFrame, columns: list[str], sample_id: str) -> tuple[DataFrame, DataFrame]:
    """The least sample of each class of equal hashes (rep and the columns), and an edge from each other member to it."""
    known = prints.where(" and ".join(f"{c} is not null" for c in columns))
    reps = materialize(known.groupBy(*columns).agg(F.min(sample_id).alias("rep")), "reps")
    return reps, known.join(reps, columns).where(F.col(sample_id) != F.col("rep")).select(F.col(sample_id).alias("a"), F.col("rep").alias("b"))


def duplicate_groups(prints: DataFrame, sample_id: str = "sample_id", strategy: str = "any", p_radius: int = 10, d_radius: int = 10, **weights: float) -> DataFrame:
    """node, root of each component of related prints, without their pairs: a class of equal hashes is a star to its least member, and only classes
    meet. For any, a class is an equal hash in either column; else both columns are equal."""
    if strategy == "any":
        edges = None
        for column, radius in (("phash", p_radius), ("dhash", d_radius)):
            reps, star = _star(prints, [column], sample_id)
            near = near_classes(reps.select(F.col(column).alias("h")), radius)
            name = lambda c, r: reps.select(F.col(column).alias(c), F.col("rep").alias(r))  # noqa: B023, E731
            found = star.union(near.join(name("h", "a"), "h").join(name("g", "b"), "g").select("a", "b"))
            edges = found if edges is None else edges.union(found)
        return clusters(edges.where("a <> b"))
    reps, star = _star(prints, ["phash", "dhash"], sample_id)
    return clusters(star.union(relationships(reps, "rep", strategy, p_radius, d_radius, **weights).select("a", "b")))


def clusters(related: DataFrame) -> DataFrame:
    """node, root (least node) of each component of the pairs (a, b): labels fall to the least neighbour's and then jump to their label's."""
    edges = materialize(related.select("a", "b").union(related.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        step = labels.join(near, "node").select("node", F.least("root", "r").alias("root"))
        jump = step.join(labels.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.coalesce(F.least("root", "far"), "root").alias("root"))
        new = materialize(jump, "labels")
        changed = new.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(edges)
            return labels


def named_clusters(components: DataFrame) -> DataFrame:
    """cluster_id, size: a name from the least member and the digest of all sorted members, which stream by. components: node, root."""
    c = joined_digests(components.select("root", F.col("node").cast("string").alias("member")), ["root"], "member", ",")
    return c.select(F.concat(F.lit("cluster_"), F.col("root").cast("string"), F.lit("_"), F.substring("digest", 1, 12)).alias("cluster_id"), F.col("n").alias("size"))
