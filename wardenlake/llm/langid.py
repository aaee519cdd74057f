"""Language identification by fusing evidence.

A row's text, declared language (markup), and address give a posterior over the languages of the training rows:

    P(l | row)  ~  P(text | l) ** t  *  P(declared | l)  *  P(l | host)

* P(text | l): naive Bayes over the letters' three-byte windows, hashed into 2**15 places, fitted to the distinct rows with a declared
  language of at most max_labelled ids, those with the least hash. It knows the max_languages most frequent languages among them (by primary
  subtag); all others are one class, OTHER. These are the only bounds here. t caps the windows that count at EVIDENCE, since neighbouring
  windows aren't independent.
* P(declared | l), from a grouped count of all rows by declared language and the language that the text alone suggests.
* P(l | host): counts of the same kind by host, smoothed towards its domain's, that towards its address suffix's, and that towards all
  rows'. A row's own guess is taken out of its counts, so that no text speaks twice.

A row is rejected if it has no letters or its best language has less than min_confidence.

Nulls and edges: null or wordless texts have no text evidence and are rejected; a null declared language or address part is no
evidence (the prior of the level above holds); languages tie to the first by name; repeated rows each get their row
(and are fitted to once); further columns may have any name; without any labelled row everything is rejected with a null language; a null doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, flat, join_small, materialize, slices, text_bytes
from .warc import PlainText

PLACES = 1 << 15
EVIDENCE = 40.0
KAPPA = 8.0
OTHER = "und"
LEVELS = ("suffix", "domain", "host")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
#: Letters are ASCII letters and the bytes of other characters; every run of anything else is one space.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the three-byte windows over the letters, and the document of each. Windows of other signs alone don't count."""
    low = _FOLD[data]
    letter = _LETTER[low]
    low = np.where(letter, low, 32)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    kept = letter.copy()
    kept[:-1] |= letter[1:]  # a space before a letter
    kept[1:] |= letter[:-1]  # and after one
    low, doc, letter = low[kept], doc[kept], letter[kept]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
    same = (doc[:-2] == doc[2:]) & (letter[:-2] | letter[1:-1])
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)[same], doc[:-2][same]


def _window_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each language of a partition: how often each place occurs."""
    counts: dict[str, np.ndarray] = {}
    for part in slices(batches, "b", 1 << 18):
        langs, texts = part.column(0).to_pylist(), part.column(1)
        for lang, text in zip(langs, texts, strict=True):
            place, _ = windows(np.frombuffer(raw := text.as_buffer(), np.uint8), np.array([0, len(raw)]))
            counts[lang] = counts.get(lang, 0) + np.bincount(place, minlength=PLACES)
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.astype("<i8").tobytes() for c in counts.values()], pa.binary())], ["lang", "counts"])


def _log_shares(pdf: pd.DataFrame) -> pd.DataFrame:
    """Logarithms of a language's smoothed shares."""
    c = np.sum([np.frombuffer(x, "<i8") for x in pdf["counts"]], axis=0)
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "log_share": [np.log((c + 0.5) / (c.sum() + 0.5 * PLACES)).astype("<f4").tobytes()]})


def train(rows: DataFrame, max_labelled: int = 4000, max_languages: int = 64) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their tables, from rows (doc_id, text, declared)."""
    labelled = rows.where("declared is not null and text is not null and doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
    chosen = materialize(labelled.select("doc_id", "h").orderBy("h", "doc_id").limit(max_labelled).distinct().select("doc_id"), "chosen")
    own = labelled.join(F.broadcast(chosen), "doc_id")  # at most max_labelled ids; equal rows of theirs count once
    sample = materialize(own.groupBy("doc_id", F.xxhash64("text").alias("t"), "declared").agg(F.first(text_bytes()).alias("b")).select("declared", "b"), "sample")
    most = Window.orderBy(F.desc("n"), "declared")  # over the sample's distinct languages
    names = sample.groupBy("declared").agg(F.count("*").alias("n")).select("declared", F.when(F.row_number().over(most) <= max_languages, F.col("declared")).otherwise(OTHER).alias("lang"))
    # windows are counted where the texts lie, however many they are; only counts meet
    counted = join_small(sample, materialize(names, "languages"), ["declared"]).select("lang", "b").mapInArrow(_window_counts, "lang string, counts binary")
    fitted = counted.groupBy("lang").applyInPandas(_log_shares, "lang string, log_share binary")
    found = sorted((r["lang"], r["log_share"]) for r in fitted.collect())  # at most max_languages + 1 tables of fixed size
    return [x for x, _ in found], np.array([np.frombuffer(b, "<f4") for _, b in found], np.float32).reshape(-1, PLACES)


def _text_evidence(tables: np.ndarray, names: list[str]):
    k = len(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "b", 1 << 18):
            place, doc = windows(*flat(part.column(part.schema.get_field_index("b"))))
            n = np.bincount(doc, minlength=part.num_rows)
            sums = np.stack([np.bincount(doc, t[place], part.num_rows) for t in tables], 1) if k else np.zeros((part.num_rows, 0))
            sums = sums * np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]  # bincount of nothing has integers
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * k), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + [pa.array(n, pa.int64()), lists], [*names, "n_windows", "text_log"])

    return run


def _dense(lists: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the lists, zero where a list is null, and which are there."""
    there = np.array(lists.is_valid())
    out = np.zeros((len(lists), k))
    out[there] = np.asarray(lists.flatten()).reshape(-1, k)
    return out, there


def _fuse(langs: list[str], every: np.ndarray, levels: list[str], min_confidence: float):
    k = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            guess = np.array(at["guess"].fill_null(-1))
            own = (guess[:, None] == np.arange(k)).astype(float)
            rest = np.maximum(every - own, 0)
            prior = (rest + 1) / (rest.sum(1, keepdims=True) + k)
            for level in levels:
                votes, there = _dense(at[level], k)
                votes = np.maximum(votes - own, 0)
                prior = np.where(there[:, None], (votes + KAPPA * prior) / (votes.sum(1, keepdims=True) + KAPPA), prior)
            said, there = _dense(at["of_declared"], k)
            # rows of a language that declare what this row does, of all rows of that language; one of each is added
            says = np.where(there[:, None], (np.maximum(said - own, 0) + 1) / (rest + k), 1.0)
            log = _dense(at["text_log"], k)[0] + np.log(prior) + np.log(says)
            top = log.argmax(1)
            confidence = (1 / np.exp(log - log.max(1, keepdims=True)).sum(1)).round(6)
            some = np.array(at["n_windows"]) > 0
            columns = [at["doc_id"], at["declared"], pa.array([langs[i] for i in top], pa.string()), pa.array(confidence), pa.array([langs[i] if i >= 0 else None for i in guess], pa.string()), pa.array(some & (confidence >= min_confidence))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "declared", "language", "confidence", "text_language", "kept"])

    return run


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], min_confidence: float = 0.6) -> DataFrame:
    """For every row of rows (doc_id, text, declared, suffix, domain, host): doc_id, declared, language, confidence, text_language, kept."""
    bound_batches(rows.sparkSession)
    langs, tables = model
    k, names = len(langs), ["doc_id", "declared", *LEVELS]
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, declared string, suffix string, domain string, host string, n_windows long, text_log array<double>"
    scored = rows.select("doc_id", *(F.col(c).cast("string") for c in names[1:]), text_bytes().alias("b")).mapInArrow(_text_evidence(tables, names), schema)
    if not langs:
        return scored.select("doc_id", "declared", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("kept"))
    guess = F.when(F.col("n_windows") > 0, F.array_position("text_log", F.array_max("text_log")).cast("int") - 1)
    scored = materialize(scored.withColumn("guess", guess), "evidence")

    votes = [F.sum((F.col("guess") == i).cast("double")) for i in range(k)]
    total = scored.where("guess is not null").agg(*votes).first()
    every = [float(x or 0) for x in total]
    known = scored.where("guess is not null")
    out = scored
    for level in LEVELS:
        counts = materialize(known.where(F.col(level).isNotNull()).groupBy(level).agg(F.array(*votes).alias(f"of_{level}")), "votes")
        out = join_small(out, counts, [level], "left")
    said = known.where("declared is not null").groupBy("declared").agg(F.array(*votes).alias("of_declared"))
    out = join_small(out, materialize(said, "votes"), ["declared"], "left")

    counts = [f"of_{level}" for level in LEVELS]
    kept = "doc_id " + dict(rows.dtypes)["doc_id"] + ", declared string, language string, confidence double, text_language string, kept boolean"
    return out.select("doc_id", "declared", "n_windows", "guess", "text_log", *counts, "of_declared").mapInArrow(_fuse(langs, np.array(every), counts, min_confidence), kept)


def _primary(lang: Column) -> Column:
    """The primary subtag in lower case: en of en-GB; null if there is none."""
    return F.nullif(F.lower(F.trim(F.split(lang.cast("string"), "[-_]")[0])), F.lit(""))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows: lang is what is declared and the source is the host; they have no address."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", _primary(F.col("lang")).alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").cast("string").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows: page_id as doc_id, the html element's lang, the parts of the url's host, and the page's plain text."""
    bound_batches(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "b"):
            found = [PlainText(x.decode("utf-8", "replace")) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(["".join(x.out) for x in found], pa.string()), pa.array([x.lang for x in found], pa.string())], ["page_id", "url", "text", "lang"])

    own = pages.select("page_id", F.col("url").cast("string").alias("url"), text_bytes("html").alias("b")).mapInArrow(read, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, lang string")
    host = F.lower(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    parts = F.split(host, r"\.")
    return own.select(F.col("page_id").alias("doc_id"), "text", _primary(F.col("lang")).alias("declared"), F.element_at(parts, -1).alias("suffix"), F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), ".")).alias("domain"), host.alias("host"))
