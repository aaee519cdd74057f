"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared folder and reads it again as the
next stage's docs. All but the last return the columns of docs.

1. language ID: documents without letters or without a clear language go; the others keep their declared language.
2. near-duplicates (five words, similarity of 0.8): of each group the document with the least doc_id stays.
3. secret scans: every secret is replaced by its kind; all documents stay.
4. mixing: sources at the weights 5, 2, 1; a document that the mix takes more than once stands there as often.
5. packing: pieces of at most 1024 identifiers placed in sequences.

Nulls and edges: see the operators. Rows that share a doc_id stay or go together in stages 1 and 2, and of those with the same text one
stays; rows with a null doc_id can't be told apart by it, so stage 1 keeps all if it keeps one, and stage 2 drops exact copies among
them only; further columns may have any name; an empty table goes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenlake.llm import langid, minhash, mixing, packing, queries, secret_scan
from wardenlake.llm.common import fresh, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language that is clear enough."""
    rows = langid.document_rows(docs)
    [key] = fresh(docs.columns, "kept_id")
    kept = langid.identify(rows, langid.train(rows)).where("kept")
    # the ids are the hashed side: whole texts stream by, unsorted
    ids = kept.select(F.col("doc_id").alias(key)).distinct().hint("shuffle_hash")
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the least doc_id."""
    rows, same = fresh(docs.columns, "rows", "same")
    kept = minhash.near_duplicates(docs, k=5, percent=80).where("kept")
    ids = kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(rows)).hint("shuffle_hash")
    named = docs.join(ids, "doc_id")
    # only rows that share a doc_id are looked at for exact copies: all others pass as they are
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    once, often = named.where(F.col(rows) == 1), named.where(F.col(rows) > 1).withColumn(same, digest).dropDuplicates(["doc_id", same])
    none = docs.where("doc_id is null").withColumn(same, digest).dropDuplicates([same])
    return once.select(*docs.columns).union(often.select(*docs.columns)).union(none.select(*docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.packing_encoder())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the text model nor the balanced sample nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
