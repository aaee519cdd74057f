"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are the distinct lower-cased words and the distinct runs of symbols at word ends, hashed into 2**16 places. One
weight vector w is shared by all grades; ordered thresholds t_1 < t_2 < ... cut the score: P(grade > k) = logistic(w.x - t_k).
The fit maximizes the penalized likelihood by L-BFGS. It takes at most max_labelled ratings, those with the least hash of
their doc_id, and at most as many distinct rows of theirs (the only bound here; all rows are scored). The model is one array of
fixed size. Scores give the expected grade and the tail probability P(grade >= least_grade), by which a text is kept.

Nulls and edges: a null or wordless text has no features and the prior's probabilities; unlabelled rows are scored alike; labels
with null grades are left out; a doc_id takes part once for each of its different grades
and texts; further columns may have any name; without labels of two grades at least
nothing can be told apart and every text is kept; a null doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, flat, materialize, mix, slices, text_bytes, word_hashes, word_spans

PLACES = 1 << 16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all documents' distinct features one after another, and each document's first."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    starts, ends, _ = word_spans(data, offsets)
    # the symbols at a word's end are its own feature, and the word is what stands before them
    last_plain = np.maximum.accumulate(np.where(_SYMBOL[data], -1, np.arange(len(data))))
    cut = np.clip(last_plain[ends - 1] + 1, starts, ends)
    hashes = np.concatenate([word_hashes(data, starts, cut, True), mix(word_hashes(data, cut, ends, True) + np.uint64(77))])
    used = np.concatenate([cut > starts, ends > cut])
    doc = np.searchsorted(offsets, np.concatenate([starts, starts]), "right") - 1
    both = np.unique(doc[used].astype(np.int64) * PLACES + (hashes[used] % np.uint64(PLACES)).astype(np.int64))
    return both % PLACES, np.searchsorted(both // PLACES, np.arange(len(offsets)))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _loss(v: np.ndarray, places: np.ndarray, row: np.ndarray, grade: np.ndarray, cuts: int, penalty: float) -> tuple[float, np.ndarray]:
    """Penalized negative log-likelihood and gradient. v: weights, then the first threshold, then logarithms of the gaps."""
    n, w = len(grade), v[:PLACES]
    t = v[PLACES] + np.concatenate([[0], np.cumsum(np.exp(v[PLACES + 1 :]))])
    score = np.bincount(row, w[places], n)
    above = np.hstack([np.ones((n, 1)), logistic(score[:, None] - t[None, :]), np.zeros((n, 1))])  # P(grade >= k)
    at = np.arange(n)
    p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-12)
    slope = above * (1 - above)
    d_score = -(slope[at, grade] - slope[at, grade + 1]) / p
    d_t = np.zeros(cuts)
    for k in range(cuts):
        d_t[k] = (slope[grade == k + 1, k + 1] / p[grade == k + 1]).sum() - (slope[grade == k, k + 1] / p[grade == k]).sum()
    gradient = np.concatenate([np.bincount(places, d_score[row], PLACES) + penalty * w, [d_t.sum()], [np.exp(v[PLACES + 1 + i]) * d_t[i + 1 :].sum() for i in range(cuts - 1)]])
    return float(-np.log(p).sum() + penalty / 2 * (w @ w)), gradient


def fit(places: np.ndarray, row: np.ndarray, grade: np.ndarray, grades: int, penalty: float = 3.0, steps: int = 80) -> np.ndarray:
    """Weights and ordered thresholds, by L-BFGS with backtracking."""
    cuts = grades - 1
    share = np.cumsum(np.bincount(grade, minlength=grades) + 0.5)[:-1] / (len(grade) + 0.5 * grades)
    t = np.log(share / (1 - share))
    v = np.concatenate([np.zeros(PLACES), t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
    loss, g = _loss(v, places, row, grade, cuts, penalty)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, back = g.copy(), []
        for s, y in reversed(memory):
            a = (s @ d) / (s @ y)
            back.append(a)
            d -= a * y
        d *= (memory[-1][0] @ memory[-1][1]) / (memory[-1][1] @ memory[-1][1]) if memory else 1 / max(1.0, np.abs(g).sum() ** 0.5 * 10)
        for (s, y), a in zip(memory, reversed(back), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        step = 1.0
        while step > 1e-6:
            new = v - step * d
            new_loss, new_g = _loss(new, places, row, grade, cuts, penalty)
            if new_loss <= loss - 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        if (new - v) @ (new_g - g) > 1e-10:
            memory = [*memory[-7:], (new - v, new_g - g)]
        done = loss - new_loss < 1e-6 * abs(loss)
        v, loss, g = new, new_loss, new_g
        if done:
            break
    return np.concatenate([v[:PLACES], v[PLACES] + np.concatenate([[0], np.cumsum(np.exp(v[PLACES + 1 :]))])])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, t, grade, b) with a text's features instead of the text."""
    for part in slices(batches, "b"):
        places, first = features(*flat(part.column(3)))
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(places, pa.int32()))], ["h", "t", "grade", "places"])


def _fit_group(grades: int, penalty: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "t", "grade"], kind="stable")  # sums in one order: reruns agree
        parts = [np.asarray(x, np.int64) for x in pdf["places"]]
        grade = pdf["grade"].to_numpy(np.int64)
        if len(np.unique(grade)) < 2:
            return pd.DataFrame({"model": []})
        model = fit(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts]), grade, grades, penalty)
        return pd.DataFrame({"model": [model.astype("<f8").tobytes()]})

    return run


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3, max_labelled: int = 6000, penalty: float = 3.0) -> np.ndarray | None:
    """The model of ratings (doc_id, grade from 0 to grades - 1) on docs (doc_id, text): one array of 2**16 + grades - 1 numbers, or None."""
    rated = ratings.where("grade is not null and doc_id is not null").select("doc_id", F.col("grade").cast("int").alias("grade"), F.xxhash64("doc_id").alias("h"))
    rated = materialize(rated.orderBy("h", "doc_id", "grade").limit(max_labelled).distinct(), "rated")
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), text_bytes().alias("b")).join(F.broadcast(rated), "doc_id")  # rated has at most max_labelled rows
    # an id may stand for any number of rows: equal ones take part once, and the whole is cut to max_labelled rows again
    found = rows.select("h", "t", "grade", "b").mapInArrow(_places, "h long, t long, grade int, places array<int>").groupBy("h", "t", "grade").agg(F.first("places").alias("places"))
    sample = found.orderBy("h", "t", "grade").limit(max_labelled)
    got = sample.groupBy().applyInPandas(_fit_group(grades, penalty), "model binary").collect()  # one row at most
    return np.frombuffer(got[0]["model"], "<f8") if got else None


def score(docs: DataFrame, model: np.ndarray | None, grades: int = 3, least_grade: int = 2, least_probability: float = 0.5) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, expected_grade, tail_probability, kept."""
    bound_batches(docs.sparkSession)
    names = ["doc_id", "expected_grade", "tail_probability"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "b"):
            places, first = features(*flat(part.column(1)))
            n = part.num_rows
            if model is None:
                above = np.ones((n, grades - 1))
            else:
                sums = np.concatenate([[0], np.cumsum(model[places])])
                above = logistic((sums[first[1:]] - sums[first[:-1]])[:, None] - model[None, PLACES:])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(above.sum(1).round(6)), pa.array(above[:, least_grade - 1].round(6))], names)

    out = docs.select("doc_id", text_bytes().alias("b")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, expected_grade double, tail_probability double")
    return out.withColumn("kept", F.col("tail_probability") >= least_probability)


def graded(labels: DataFrame) -> DataFrame:
    """Grades from labels (doc_id, quality, toxic): 0 toxic, 1 poor, 2 good; null if either is null."""
    known = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    return labels.select("doc_id", F.when(known, F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)).alias("grade"))
