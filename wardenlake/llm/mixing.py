"""Mixing sources to target weights by balanced sampling (the cube method).

Each source's target is its weight's share of all words, stopped at a multiple of what the source has, the excess reshared by
weight (water filling). A document is taken floor(r) times, r being target over size, and once more with the fractional inclusion
probability. The flight phase moves these probabilities along the null space of two balancing constraints a source, the total of
words and the number of documents, until at most two a block remain fractional; what remains of all blocks flies again, level by
level, until one block a source is left; its last LANDING fall to the choice nearest the expected totals (the landing phase). So a source's words
miss its target by a few documents at most, whatever its size.

Blocks are of bounded size and hashed by document, so a hot source is many tasks. Order and randomness come from hashes of the rows
alone: reruns agree.

Nulls and edges: a null or wordless text has size 0 and takes 0 words; null is a source of its own, last in order;
repeated rows are sampled each (n equal ones count as n times the fraction, so that a large group of copies meets its target to one row); a
doc_id of any type and size stays as it is, null too; equal sizes are told apart by the rows' digests; further columns may have any name; with
no words at all every target is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

BLOCK = 1024
EPS = 1e-9
LANDING = 14
WORDS = r"[^\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def flight(p: np.ndarray, size: np.ndarray, noise: np.ndarray, leave: int = 2) -> np.ndarray:
    """Move probabilities along the null space of (1, size) until at most leave (2 or more) are fractional. Sums of p and of p * size stay."""
    p = p.copy()
    live: list[int] = []
    at, open_ones = 0, int(((p > EPS) & (p < 1 - EPS)).sum())
    while open_ones > leave:
        while len(live) < 3:
            if EPS < p[at] < 1 - EPS:
                live.append(at)
            at += 1
        i, j, k = live
        a, b, c = float(size[i]), float(size[j]), float(size[k])
        v = (c - b, a - c, b - a)  # sums to 0, and so do its products with the sizes
        if a == b == c:
            v = (1.0, -1.0, 0.0)
        up = min(((1 - p[x]) / d if d > 0 else -p[x] / d) for x, d in zip(live, v, strict=True) if d)
        down = min((p[x] / d if d > 0 else (p[x] - 1) / d) for x, d in zip(live, v, strict=True) if d)
        step = up if noise[i] * (up + down) < down else -down
        for x, d in zip(live, v, strict=True):
            p[x] = min(1.0, max(0.0, p[x] + step * d))
            if p[x] <= EPS or p[x] >= 1 - EPS:
                p[x] = round(p[x])
        live = [x for x in live if 0 < p[x] < 1]
        open_ones -= 3 - len(live)
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The at most LANDING that are left: the whole choice whose words, then documents, come nearest the expected."""
    out, left = p.copy(), np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if len(left) > LANDING:
        raise ValueError("landing before the flight ended")
    picks = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
    words, docs = np.abs((picks - p[left]) @ size[left]), np.abs((picks - p[left]).sum(1))
    out[left] = picks[np.lexsort((docs.round(6), words.round(6)))[0]]
    return np.rint(out)


def n_words(text: Column) -> Column:
    """The words of a text, null as none. Each becomes one character and the white space goes: a list of the words would take many times the text's memory."""
    return F.when(text.isNull(), 0).otherwise(F.length(F.translate(F.regexp_replace(text, WORDS, "x"), SPACES, ""))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """From rows (source, size): source, source_size, n_docs, target. The windows run over one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    per = per.withColumn("full", F.col("cap") < F.col("w") * F.col("level"))
    last = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("o"), F.col("source").isNull().alias("z"), F.coalesce("source", F.lit("")).alias("s"), F.col("level").alias("level")))).over(every)
    return per.select("source", "source_size", "n_docs", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * last["level"]).alias("target"))


def _unit(docs: DataFrame) -> Column:
    """A digest of all of a row's columns as they read. doc_ids of any type and size, null or not, so never go through pandas."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(part(docs[c].cast("string")) for c in docs.columns)), 256)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 8) -> DataFrame:
    """A row for each unit of docs (doc_id, text, source, ..), which is all rows that are equal in every column: unit (its digest), doc_id, size, n
    (its rows), source, source_size, target, whole (how often the mix takes each row) and more (how many of the rows it takes once more)."""
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _unit(docs).alias("unit")), "sizes")
    target = materialize(source_targets(sized, weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    r = F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio)
    plain = target.select(F.col("source").alias("of"), "source_size", "n_docs", "target", F.floor(r).alias("whole"), (r - F.floor(r)).alias("share"))
    units = sized.groupBy("unit", "size", "source").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    # of n equal rows with the fraction p each, floor(n p) are taken for certain, and the cube method decides on one more
    rows = units.join(plain, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("sure", F.floor(F.col("n") * F.col("share"))).withColumn("p", F.col("n") * F.col("share") - F.col("sure"))
    flying = rows.where("p > 0 and size > 0").select("source", "unit", F.col("size").alias("weight"), "p", F.xxhash64("unit", F.lit(seed)).alias("u"), F.col("n_docs").alias("left"))
    schema = "source string, unit string, weight long, p double, u long"

    def fly(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["u", "unit"], kind="stable", ignore_index=True)
            noise = np.random.default_rng([seed, int(pdf["u"].iloc[0]) & 0x7FFFFFFF]).random(len(pdf))
            sizes = pdf["weight"].to_numpy(float)
            p = flight(pdf["p"].to_numpy(float), sizes, noise, LANDING if last else 2)
            pdf["p"] = land(p, sizes) if last else p
            return pdf[["source", "unit", "weight", "p", "u"]]

        return run

    done, level = None, 0
    blocks = -(-int(target.agg(F.max("n_docs")).first()[0] or 0) // BLOCK)
    while True:
        last = blocks <= 1
        block = F.lit(0) if last else F.pmod(F.xxhash64("u", F.lit(level)), F.ceil(F.col("left") / BLOCK))
        out = materialize(flying.withColumn("block", block).drop("left").groupBy("source", "block").applyInPandas(fly(last), schema), "flight")
        settled = out.where("p = 0 or p = 1")
        done = settled if done is None else done.union(settled)
        if last:
            break
        level += 1
        rest = out.where("p > 0 and p < 1")
        counts = rest.groupBy("source").agg(F.count("*").alias("left")).withColumnRenamed("source", "of")
        flying = rest.join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        blocks = -(-int(counts.agg(F.max("left")).first()[0] or 0) // BLOCK)
    extra = done.where("p = 1").select("unit", F.lit(1).alias("extra"))
    return rows.join(extra, "unit", "left").select("unit", "doc_id", "size", "n", "source", "source_size", "target", "whole", (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("more"))


def _times(df: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row n times, numbered from 0 in the column name: by stretches, so that no array grows with n as a whole."""
    [start] = fresh(df.columns, "start")
    stretches = df.withColumn(name, n).where(F.col(name) > 0).withColumn(start, F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1, F.lit(4096).cast("long"))))
    return stretches.withColumn(name, F.explode(F.sequence(F.col(start), F.least(F.col(start) + 4095, F.col(name) - 1)))).drop(start)


def mix_words(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 8) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, taken (words that the mix takes of it, repeats counted)."""
    out = _times(mix(docs.select("doc_id", "text", "source"), weights, most, seed), F.col("n"), "i")
    return out.select("doc_id", "size", "source_size", "target", ((F.col("whole") + (F.col("i") < F.col("more")).cast("long")) * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 8) -> DataFrame:
    """The rows of docs as the mix has them: as many of each as it takes, with docs' columns."""
    key, often, i = fresh(docs.columns, "unit_key", "often", "i")
    chosen = mix(docs, weights, most, seed).select(F.col("unit").alias(key), "n", (F.col("n") * F.col("whole") + F.col("more")).alias(often)).where(F.col(often) > 0)
    chosen = materialize(chosen, "chosen")
    keyed = docs.withColumn(key, _unit(docs))
    out = _times(keyed.join(chosen.where("n = 1").drop("n"), key), F.col(often), i).select(*docs.columns)
    repeated = chosen.where("n > 1").drop("n")
    if repeated.isEmpty():
        return out
    # rows that are equal in every column: one stands for all
    return out.union(_times(keyed.join(repeated, key).dropDuplicates([key]), F.col(often), i).select(*docs.columns))
