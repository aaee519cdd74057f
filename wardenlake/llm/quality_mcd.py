"""Quality rules with robust multivariate outliers.

Base rules fail a text with fewer than 50 words or with over half its words in repeated three-word windows. The texts that pass give
a vector of transformed statistics. For each language and source (and for each language, and for all, as fallbacks for groups of
fewer than MIN_ROWS) a minimum covariance determinant estimate is made by concentration steps: again and again take mean and covariance
of the h = 3/4 of the rows that are nearest by Mahalanobis distance. STARTS starts (medians and MADs; mean and covariance of all rows; those
of about SUBSET rows chosen by hash) take FIRST steps each, the one with the least determinant then goes on; a step that would raise
the determinant isn't taken. A text is rejected if its squared distance, scaled so that the group's median is that of chi-square, exceeds CUT.

Every step is one grouped aggregation over all rows: distances fall into bins of their logarithm, a bin's count and moment sums
are added up (partially before the shuffle, so a hot source is no hot task), and each group's few hundred bins give the next
estimate; the bin in which h is reached counts in part. A floor on each variance keeps statistics that are nearly constant (no
repeated lines at all) from rejecting ordinary texts.

Nulls and edges: a null text has no words and fails; a null language or source is a group of its own; repeated rows count each; equal
determinants go to the first start; a null doc_id stays null; further columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, flat, join_small, materialize, slices, text_bytes, window_hashes, word_hashes, word_spans

FEATURES = ("log_words", "log_word_length", "log_symbols", "dup_lines", "repeats", "log_variety", "log_line_words")
#: Least standard deviation of each feature.
FLOOR = (0.30, 0.08, 0.60, 0.15, 0.10, 0.12, 0.50)
D = len(FEATURES)
KEEP = 0.75
STARTS, FIRST, STEPS = 4, 2, 5
SUBSET = 3 * D
MIN_ROWS = 100
CUT = 60.0
SCALE = 16  # bins a factor of e in squared distance
MEDIAN = D * (1 - 2 / (9 * D)) ** 3  # of chi-square with D degrees of freedom
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def text_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "b"):
        texts = part.column(part.schema.get_field_index("b"))
        data, offsets = flat(texts)
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends, False)
        windows = window_hashes(words, 3)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        chars = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])[first]
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])[offsets]
        rows = []
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            repeated = 0
            if b - a >= 4:
                _, back, count = np.unique(windows[a : b - 2], return_inverse=True, return_counts=True)
                twice = np.flatnonzero(count[back] > 1)
                if len(twice):
                    inside = np.zeros(b - a, bool)
                    for j in range(3):
                        inside[twice + j] = True
                    repeated = int(inside.sum())
            lines = [x for x in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") if x.strip()]
            rows.append((b - a, len(lines) - len(set(lines)), repeated, len(np.unique(words[a:b])), len(lines)))
        counts = np.array(rows, np.int64).reshape(-1, 5)
        more = {"n_words": counts[:, 0], "word_chars": np.diff(chars), "n_symbols": np.diff(symbols), "n_dup_lines": counts[:, 1], "n_repeat_words": counts[:, 2], "n_distinct": counts[:, 3], "n_lines": counts[:, 4]}
        keep = [c for c in part.schema.names if c != "b"]
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + [pa.array(v, pa.int64()) for v in more.values()], keep + list(more))


def _vector():
    n, lines = F.col("n_words").cast("double"), F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return F.array(
        F.log(n), F.log(F.col("word_chars") / n), F.log(F.lit(1e-3) + F.col("n_symbols") / F.col("word_chars")), F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / n), F.log(F.col("n_distinct") / n), F.log(n / lines),
    )


def _group(level: int):
    name = (F.struct("lang", "source"), F.struct("lang"), F.struct())[level] if level < 2 else None
    return F.concat(F.lit(f"{level}:"), F.to_json(name)) if level < 2 else F.lit("2:")


def _estimate(mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float], float]:
    """Mean, the flattened inverse Cholesky factor of the floored covariance, and the logarithm of its determinant."""
    cov = cov + np.diag(np.maximum(np.square(FLOOR) - np.diag(cov), 0) + 1e-9)
    factor = np.linalg.cholesky(cov)
    return mean.tolist(), np.linalg.inv(factor).ravel().tolist(), float(2 * np.log(np.diag(factor)).sum())


_PARAMETERS = "g string, start int, n long, mean array<double>, root array<double>, log_det double, unit double"


def _parameters(g: str, start: int, n: int, mean: np.ndarray, cov: np.ndarray, unit: float) -> pd.DataFrame:
    m, root, log_det = _estimate(mean, cov)
    return pd.DataFrame({"g": [g], "start": [start], "n": [n], "mean": [m], "root": [root], "log_det": [log_det], "unit": [unit]})


def _begin(pdf: pd.DataFrame) -> pd.DataFrame:
    """Medians and MADs from counts of values in 64ths."""
    mean, mad, n = np.zeros(D), np.zeros(D), 0
    for f, own in pdf.groupby("f"):
        x, c = own["v"].to_numpy(float) / 64 + 1 / 128, own["c"].to_numpy(float)
        middle = lambda x: (o := np.argsort(x)) is not None and x[o][np.searchsorted(np.cumsum(c[o]), c.sum() / 2)]  # noqa: B023, E731
        mean[f] = middle(x)
        mad[f] = middle(np.abs(x - mean[f]))
        n = int(c.sum())
    return _parameters(pdf["g"].iloc[0], 0, n, mean, np.diag(np.square(1.4826 * mad)), 1.0)


def _moments(s1: np.ndarray, s2: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from a count, sums and the upper triangle of sums of products."""
    mean, cov = s1 / n, np.zeros((D, D))
    cov[np.triu_indices(D)] = s2 / n
    return mean, np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)


_SUMS = [f"s{i}" for i in range(D)]
_PRODUCTS = [f"q{i}_{j}" for i in range(D) for j in range(i, D)]


def _from_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """A start from moments of some of the rows."""
    r = pdf.iloc[0]
    mean, cov = _moments(r[_SUMS].to_numpy(float), r[_PRODUCTS].to_numpy(float), float(r["c"]))
    return _parameters(r["g"], int(r["start"]), int(r["n"]), mean, cov, 1.0)


def _concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """The next estimate from bins of distance: counts, sums of the features and of their products."""
    pdf = pdf.sort_values("bin")
    c = pdf["c"].to_numpy(float)
    n, h = c.sum(), max(1.0, KEEP * c.sum())
    before = np.concatenate([[0], np.cumsum(c)[:-1]])
    share = np.clip((h - before) / c, 0, 1)  # of each bin
    mean, cov = _moments((pdf[_SUMS].to_numpy(float) * share[:, None]).sum(0), (pdf[_PRODUCTS].to_numpy(float) * share[:, None]).sum(0), h)
    middle = math.exp((pdf["bin"].to_numpy(float)[np.searchsorted(np.cumsum(c), n / 2)] + 0.5) / SCALE)
    return _parameters(pdf["g"].iloc[0], int(pdf["start"].iloc[0]), int(n), mean, cov, max(middle / MEDIAN, 1.0))


def _distance():
    z = [F.col("x")[i] - F.col("mean")[i] for i in range(D)]
    total = F.lit(0.0)
    for i in range(D):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col("root")[i * D + j] * z[j]
        total = total + part * part
    return total


def statistics(docs: DataFrame) -> DataFrame:
    """The base counts of every row: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct, n_lines."""
    bound_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_distinct long, n_lines long"
    return docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), text_bytes().alias("b")).mapInArrow(text_statistics, schema)


def minimum_determinant(rows: DataFrame) -> DataFrame:
    """The estimate of each group of rows (g, x): g, start (that it came from), n, mean, root, log_det, unit (scale of the last step's distances)."""
    counts = rows.select("g", F.posexplode("x").alias("f", "v")).groupBy("g", "f", F.floor(F.col("v") * 64).alias("v")).agg(F.count("*").alias("c"))
    first = materialize(counts.groupBy("g").applyInPandas(_begin, _PARAMETERS), "mcd")
    # sums of the features and of their products: their logarithms and roots are small numbers, so that little cancels
    sums = [F.count("*").alias("c"), *(F.sum(F.col("x")[i]).alias(s) for i, s in enumerate(_SUMS)), *(F.sum(F.col("x")[int(s[1])] * F.col("x")[int(s[3])]).alias(s) for s in _PRODUCTS)]
    starts = join_small(rows, first.select("g", "n"), ["g"]).withColumn("start", F.explode(F.array(*(F.lit(i) for i in range(1, STARTS)))))
    chosen = (F.col("start") == 1) | (F.pmod(F.xxhash64("x", "start"), F.greatest(F.floor(F.col("n") / SUBSET), F.lit(1))) == 0)
    others = starts.where(chosen).groupBy("g", "start", "n").agg(*sums).groupBy("g", "start").applyInPandas(_from_rows, _PARAMETERS)
    now = materialize(first.union(others), "mcd")
    best = None
    for step in range(FIRST + STEPS):
        near = join_small(rows, now.drop("n"), ["g"]).withColumn("bin", F.floor(F.log(_distance() + 1e-12) * SCALE))
        now = near.groupBy("g", "start", "bin").agg(*sums).groupBy("g", "start").applyInPandas(_concentrate, _PARAMETERS)
        if step >= FIRST - 1:
            # the starts' best; after that a step that raises the determinant (bins count in part) isn't taken
            both = now if best is None else now.union(best)
            fields = ["start", "n", "mean", "root", "log_det", "unit"]
            best = now = materialize(both.groupBy("g").agg(F.min_by(F.struct(*fields), F.struct("log_det", "start")).alias("p")).select("g", *(f"p.{c}" for c in fields)), "mcd")
        else:
            now = materialize(now, "mcd")
    return now


def quality(docs: DataFrame, min_words: int = 50, repeat_percent: int = 50, cut: float = CUT) -> DataFrame:
    """For every row of docs (doc_id, text, lang, source): the base counts, base_failed, distance (squared, scaled; null where base_failed) and kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    stats = materialize(statistics(docs).withColumn("base_failed", failed), "statistics")
    vectors = stats.where("not base_failed").select("doc_id", "lang", "source", _vector().alias("x"))
    large = minimum_determinant(vectors.select(F.explode(F.array(*(_group(i) for i in range(3)))).alias("g"), "x")).where(F.col("n") >= MIN_ROWS)
    chosen = stats.withColumn("x", F.when(~F.col("base_failed"), _vector()))
    for level in range(3):
        own = large.where(F.col("g").startswith(f"{level}:")).select(F.col("g").alias(f"g{level}"), F.struct("mean", "root", "unit").alias(f"p{level}"))
        chosen = join_small(chosen.withColumn(f"g{level}", _group(level)), own, [f"g{level}"], "left")
    chosen = chosen.withColumn("p", F.coalesce("p0", "p1", "p2")).select(*stats.columns, "x", "p.mean", "p.root", "p.unit")
    out = chosen.withColumn("distance", _distance() / F.col("unit"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).drop("x", "mean", "root", "unit")
