"""Checks of model inputs and outputs, and comparisons of replays. Tensors: shape (array<int>), data (array<double>)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import discard, materialize
from ..functions.stats import clamp


#: An image with more boxes of both sides than this is crowded: its boxes meet on a grid and not in one task.
CROWD = 256
#: Types by whose order and equality Arrow and Spark agree.
_PLAIN = {"boolean", "tinyint", "smallint", "int", "bigint", "date", "string"}


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def summarize(data: Column) -> dict[str, Column]:
    """Counts of NaN and infinities, least and greatest finite value, mean of the finite, class of the range of values."""
    good = F.filter(data, _finite)
    low, high = F.array_min(good), F.array_max(good)
    count = lambda f: F.size(F.filter(data, f)).cast("long")
    kind = F.when(F.size(good) == 0, "EMPTY").when((low >= 0) & (high <= 1), "UNIT").when((low >= -1) & (high <= 1), "SIGNED_UNIT").when((low >= 0) & (high <= 255), "BYTE").otherwise("UNBOUNDED")
    mean = F.aggregate(good, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(good) > 0, F.size(good))
    return {"n": F.size(data).cast("long"), "n_nan": count(F.isnan), "n_pos_inf": count(lambda x: x == float("inf")), "n_neg_inf": count(lambda x: x == float("-inf")), "low": low, "high": high, "mean": mean, "range_class": kind}


def layout(shape: Column) -> Column:
    """NCHW or NHWC by where a small number of channels stands; AMBIGUOUS if both fit."""
    small = lambda x: x.isin(1, 3, 4)
    first, last = small(F.get(shape, F.lit(1))), small(F.get(shape, F.lit(3)))
    return F.when(F.size(shape) != 4, "UNKNOWN").when(first & last, "AMBIGUOUS").when(first, "NCHW").when(last, "NHWC").otherwise("UNKNOWN")


def shape_matches(shape: Column, data: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x) == F.size(data)


def classification_faults(probs: Column, tolerance: float = 1e-3) -> Column:
    """Array of what is wrong with class probabilities."""
    bad = F.exists(probs, lambda x: ~_finite(x))
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    return F.array_compact(F.array(F.when(F.size(probs) == 0, "EMPTY"), F.when(bad, "NON_FINITE"), F.when(~bad & F.exists(probs, lambda x: (x < 0) | (x > 1)), "OUT_OF_RANGE"), F.when(~bad & (F.abs(total - 1) > tolerance), "SUM_NOT_ONE")))


def detection_faults(box: Column, score: Column, label: Column, width: Column, height: Column, n_classes: int) -> Column:
    """Array of what is wrong with a box (x1, y1, x2, y2)."""
    x1, y1, x2, y2 = (F.get(box, F.lit(i)) for i in range(4))
    return F.array_compact(F.array(
        F.when(F.size(box) != 4, "NOT_A_BOX"), F.when((x2 <= x1) | (y2 <= y1), "BOX_ORDER"), F.when((x1 < 0) | (y1 < 0) | (x2 > width) | (y2 > height), "OUT_OF_IMAGE"),
        F.when(~_finite(score) | (score < 0) | (score > 1), "BAD_SCORE"), F.when((label < 0) | (label >= n_classes), "UNKNOWN_CLASS"),
    ))


def embedding_faults(vector: Column, unit: bool = True, tolerance: float = 1e-3) -> Column:
    bad = F.exists(vector, lambda x: ~_finite(x))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.array_compact(F.array(F.when(F.size(vector) == 0, "EMPTY"), F.when(bad, "NON_FINITE"), F.when(~bad & (norm == 0), "ZERO_VECTOR"), F.when(F.lit(unit) & ~bad & (F.abs(norm - 1) > tolerance), "NOT_UNIT")))


def segmentation_faults(mask: Column, height: Column, width: Column, n_classes: int) -> Column:
    return F.array_compact(F.array(F.when(F.size(mask) != height * width, "WRONG_SIZE"), F.when(F.exists(mask, lambda x: (x < 0) | (x >= n_classes)), "UNKNOWN_CLASS")))


def mask_agreement(a: Column, b: Column, n_classes: int) -> dict[str, Column]:
    """Pixel accuracy and mean intersection over union of the classes that either mask has."""
    pairs = F.arrays_zip(a.alias("p"), b.alias("q"))
    n = lambda f: F.size(F.filter(pairs, f)).cast("double")
    ious = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.try_divide(n(lambda s: (s["p"] == k) & (s["q"] == k)), n(lambda s: (s["p"] == k) | (s["q"] == k))))
    present = F.array_compact(ious)
    return {"pixel_accuracy": n(lambda s: s["p"] == s["q"]) / F.size(pairs), "mean_iou": F.try_divide(F.aggregate(present, F.lit(0.0), lambda t, x: t + x), F.size(present).cast("double"))}


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2)."""
    g = lambda v, i: F.get(v, F.lit(i))
    w = F.greatest(F.lit(0.0), F.least(g(a, 2), g(b, 2)) - F.greatest(g(a, 0), g(b, 0)))
    h = F.greatest(F.lit(0.0), F.least(g(a, 3), g(b, 3)) - F.greatest(g(a, 1), g(b, 1)))
    area = lambda v: (g(v, 2) - g(v, 0)) * (g(v, 3) - g(v, 1))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


#: How a box of four numbers is written: corners, least corner and sides, centre and sides.
BOX_FORMS = ("xyxy", "xywh", "cxcywh")


def box_form(box: Column, given: str, wanted: str, width: Column | None = None, height: Column | None = None) -> Column:
    """The box in another form; with width and height given numbers are shares of the image's sides and become pixels. Null unless box has four numbers that are finite."""
    if given not in BOX_FORMS or wanted not in BOX_FORMS:
        raise ValueError(f"a form of boxes is one of {BOX_FORMS}")
    a, b, c, d = (F.get(box, F.lit(i)).cast("double") * (F.lit(1.0) if side is None else side) for i, side in enumerate((width, height, width, height)))
    w, h = (c - a, d - b) if given == "xyxy" else (c, d)
    x, y = (a - w / 2, b - h / 2) if given == "cxcywh" else (a, b)
    out = {"xyxy": (x, y, x + w, y + h), "xywh": (x, y, w, h), "cxcywh": (x + w / 2, y + h / 2, w, h)}[wanted]
    return F.when((F.size(box) == 4) & F.forall(box, lambda v: F.coalesce(_finite(v), F.lit(False))), F.array(*out))


def box_area(box: Column) -> Column:
    """Of corners; a box turned inside out has none."""
    w, h = (F.get(box, F.lit(i + 2)) - F.get(box, F.lit(i)) for i in (0, 1))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def displacement(a: Column, b: Column) -> Column:
    """How far the centres of two boxes (corners) lie apart."""
    x, y = ((F.get(b, F.lit(i)) + F.get(b, F.lit(i + 2)) - F.get(a, F.lit(i)) - F.get(a, F.lit(i + 2))) / 2 for i in (0, 1))
    return F.sqrt(x * x + y * y)


def matched(reference: Column, candidate: Column, at: float = 0.5) -> Column:
    """n, mean_iou, same (pairs of one label) of two arrays of boxes (box, label, score): greedy one-to-one matching by IoU, class agreement, confidence,
    as a fold over the sorted pairs. Two empty arrays agree wholly; without a match mean_iou is 0."""
    by_score = lambda v: F.array_sort(v, lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise(0))
    pairs = F.flatten(F.transform(by_score(reference), lambda x, i: F.transform(by_score(candidate), lambda y, k: F.struct((-iou(x["box"], y["box"])).alias("d"), (-(x["label"] == y["label"]).cast("int")).alias("s"), (-y["score"]).alias("z"), i.alias("i"), k.alias("k")))))
    sorted_pairs = F.array_sort(F.filter(pairs, lambda p: -p["d"] >= at))
    start = F.struct(F.array().cast("array<int>").alias("i"), F.array().cast("array<int>").alias("k"), F.lit(0.0).alias("t"), F.lit(0).alias("same"))

    def take(a: Column, p: Column) -> Column:
        free = ~F.array_contains(a["i"], p["i"]) & ~F.array_contains(a["k"], p["k"])
        return F.when(free, F.struct(F.concat(a["i"], F.array(p["i"])).alias("i"), F.concat(a["k"], F.array(p["k"])).alias("k"), (a["t"] - p["d"]).alias("t"), (a["same"] - p["s"]).alias("same"))).otherwise(a)

    def finish(a: Column) -> Column:
        n = F.size(a["i"])
        empty = (F.coalesce(F.size(reference), F.lit(0)) <= 0) & (F.coalesce(F.size(candidate), F.lit(0)) <= 0)
        return F.struct(n.alias("n"), F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(a["t"], n.cast("double")), F.lit(0.0))).alias("mean_iou"), a["same"].alias("same"))

    return F.aggregate(F.coalesce(sorted_pairs, F.array().cast("array<struct<d:double,s:int,z:double,i:int,k:int>>")), start, take, finish)


def _sides(box: Column) -> tuple[Column, Column, Column, Column]:
    x1, y1, x2, y2 = (F.get(box, F.lit(i)) for i in range(4))
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def _extended(box: Column) -> Column:
    """Whether a box has a positive, finite area."""
    x, y, w, h = _sides(box)
    return (w > 0) & (h > 0) & _finite(x) & _finite(y) & _finite(F.greatest(w, h)) & (F.size(box) == 4)


def overlapping(reference: DataFrame, candidate: DataFrame, image: str, at: float) -> DataFrame:
    """image, r, c, iou of the pairs of boxes (id, box) of one image that overlap by at least `at`, which is above 0. Boxes meet by the cell of their centre on a grid as fine as
    they are large, not by image: boxes whose IoU is `at` differ by at most 1 / at in their longer side and by (1 - at) times that side in their centres. So a crowded
    image is no group, and each pair meets in one cell. Boxes without a positive, finite area pair with none."""
    if not 0 < at <= 1:
        raise ValueError("at must be above 0 and at most 1")

    def placed(df: DataFrame) -> DataFrame:
        x, y, w, h = _sides(F.col("box"))
        side = F.greatest(w, h)
        return df.where(_extended(F.col("box"))).select(image, "id", "box", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), side.alias("side"), F.floor(F.log2(side)).cast("int").alias("size"))

    cell = lambda v, size: F.floor(v / F.pow(F.lit(2.0), size + 1))
    reach = math.ceil(math.log2(1 / at)) + 1  # one more, since a logarithm may be rounded
    c = placed(candidate).select(image, "size", cell(F.col("x"), F.col("size")).alias("u"), cell(F.col("y"), F.col("size")).alias("v"), F.col("id").alias("c"), F.col("box").alias("q"))
    r = placed(reference).select("*", F.explode(F.sequence(F.col("size") - reach, F.col("size") + reach)).alias("other"))
    far = lambda w: F.greatest(w, F.least(F.pow(F.lit(2.0), F.col("other") + 1), w / at)) * (1 - at + 1e-9)
    spread = lambda v, w: F.sequence(cell(v - far(w), F.col("other")), cell(v + far(w), F.col("other")))
    r = r.where(F.pow(F.lit(2.0), F.col("other")) <= F.col("side") / at * 1.000001).where(F.pow(F.lit(2.0), F.col("other") + 1) >= F.col("side") * at * 0.999999)
    r = r.select(image, "id", "box", "other", F.explode(spread(F.col("x"), F.col("w"))).alias("u"), "y", "h").select(image, F.col("id").alias("r"), F.col("box").alias("p"), F.col("other").alias("size"), "u", F.explode(spread(F.col("y"), F.col("h"))).alias("v"))
    return r.join(c, [image, "size", "u", "v"]).withColumn("iou", iou(F.col("p"), F.col("q"))).where(F.col("iou") >= at).select(image, "r", "c", "iou")


def dominant(pairs: DataFrame, left: str, right: str, order: str, n_left: str, n_right: str) -> DataFrame:
    """The pairs that a greedy pass by ascending order takes, with n, how often: each left can be taken n_left times and each right n_right times. Order must be without ties. In a
    round, every pair that comes first for both its sides is taken as often as they allow; no pair before it can use them up, so the greedy pass takes the same. Pairs of which a side is used up go.
    Rounds are as many as the longest chain in which each pair waits for the one before, two or three where boxes are apart; a round writes what it takes and what is left."""
    rest, taken = materialize(pairs, "pairs"), []
    while rest.head() is not None:
        first = lambda side: rest.groupBy(side).agg(F.min(order).alias(f"__{side}"))  # noqa: E731, B023
        best = rest.join(first(left), left).join(first(right), right).where((F.col(f"__{left}") == F.col(order)) & (F.col(f"__{right}") == F.col(order)))
        best = materialize(best.select(*pairs.columns, F.least(n_left, n_right).alias("n")), "taken")
        taken.append(best)
        used = lambda side, n: best.select(side, F.col("n").alias(f"__{n}"))  # noqa: E731, B023
        after = rest.join(used(left, n_left), left, "left").join(used(right, n_right), right, "left")
        after = after.withColumns({n: F.col(n) - F.coalesce(F.col(f"__{n}"), F.lit(0)) for n in (n_left, n_right)}).where((F.col(n_left) > 0) & (F.col(n_right) > 0))
        after = materialize(after.select(*pairs.columns), "pairs")
        discard(rest)
        rest = after
    return reduce(DataFrame.unionByName, taken) if taken else rest.withColumn("n", F.lit(0).cast("long"))


def _greedy(r: np.ndarray, c: np.ndarray, keys: Sequence[np.ndarray]) -> np.ndarray:
    """The places of the pairs (r, c) that a greedy one-to-one pass by keys takes; the first key counts most, pairs alike in all go by place. Pairs that share no side with another need no order."""
    if not len(r):
        return np.array([], np.int64)
    alone = (np.bincount(r)[r] == 1) & (np.bincount(c)[c] == 1)
    taken, left = [np.flatnonzero(alone)], np.flatnonzero(~alone)
    left = left[np.lexsort([k[left] for k in reversed(keys)])]
    while len(left):
        first = []
        for side in (r[left], c[left]):
            at = np.empty(side.max() + 1, np.int64)
            at[side[::-1]] = np.arange(len(left))[::-1]  # the last that is written is the first pair
            first.append(at[side] == np.arange(len(left)))
        best = left[first[0] & first[1]]
        taken.append(best)
        left = left[~np.isin(r[left], r[best]) & ~np.isin(c[left], c[best])]
    return np.concatenate(taken)


def _codes(column: pa.Array) -> np.ndarray:
    """Places of the values in their order, -1 for null."""
    d = column.dictionary_encode()
    place = np.empty(len(d.dictionary), np.int64)
    place[pc.sort_indices(d.dictionary).to_numpy()] = np.arange(len(d.dictionary))
    at = d.indices.fill_null(-1).to_numpy().astype(np.int64)
    return np.where(at < 0, -1, place[at] if len(place) else -1)


def _match_images(rows: pa.Table, start: np.ndarray, at: float) -> pa.RecordBatch:
    """image, a, b, m, s, t of whole images; start: where each begins. All images go through at once, as arrays."""
    column = lambda name: rows[name].combine_chunks()
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(rows))))
    ref = column("ref").to_numpy(zero_copy_only=False)
    box = np.stack([column(x).to_numpy(zero_copy_only=False) for x in ("x1", "y1", "x2", "y2")])
    label, score, good = _codes(column("label")), column("score").to_numpy(zero_copy_only=False), ~np.isnan(box[0])
    count = lambda mask, weight=None: np.bincount(of[mask], weight, len(start))
    rs, cs = np.flatnonzero(ref & good), np.flatnonzero(~ref & good)
    others = count(~ref & good)
    n = others[of[rs]]
    r = np.repeat(rs, n)
    c = cs[np.repeat((np.cumsum(others) - others)[of[rs]] - (np.cumsum(n) - n), n) + np.arange(len(r))]
    p, q = box[:, r], box[:, c]
    with np.errstate(all="ignore"):
        both = np.maximum(0.0, np.minimum(p[2], q[2]) - np.maximum(p[0], q[0])) * np.maximum(0.0, np.minimum(p[3], q[3]) - np.maximum(p[1], q[1]))
        found = both / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both)
    near = np.flatnonzero(~(found < at))
    r, c, found = r[near], c[near], found[near]
    same = label[r] == label[c]
    taken = _greedy(r, c, [-found, ~same, score[c], score[r], *box[:, r], *box[:, c], label[r], label[c]])
    hit, same, found = r[taken], same[taken], found[taken]
    got = [count(ref), count(~ref), count(hit), count(hit[same]), count(hit, found)]
    return pa.RecordBatch.from_arrays([column("image").take(pa.array(start)), *(pa.array(x, pa.float64() if name == "t" else pa.int64()) for name, x in zip("abmst", got, strict=True))], names=["image", *"abmst"])


def _match_sorted(batches: Iterator[pa.RecordBatch], at: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by image; an image that goes on in the next batch waits for it."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not len(rows):
            continue
        ends = pc.run_end_encode(rows["image"].combine_chunks()).run_ends.to_numpy()
        start = np.append(0, ends[:-1]).astype(np.int64)
        if len(start) > 1:
            yield _match_images(rows.slice(0, start[-1]), start[:-1], at)
        held = rows.slice(start[-1])
    if held is not None and len(held):
        yield _match_images(held, np.zeros(1, np.int64), at)


def _of_crowds(reference: DataFrame, candidate: DataFrame, at: float) -> DataFrame:
    """image, a, b, m, s, t: as _match_images has them, for images with any number of boxes, which meet on a grid. Boxes that are alike in all are one with a count."""

    def classes(df: DataFrame) -> DataFrame:
        kept = df.groupBy(F.struct("image").alias("__image"), "box", "label", "score").agg(F.count("*").alias("k"))  # a struct of null joins as a value
        return materialize(kept.withColumn("id", F.monotonically_increasing_id()), "boxes")  # written, so that numbers stay what they are

    r, c = classes(reference), classes(candidate)
    side = lambda df, n: df.select(F.col("id").alias(n), F.col("k").alias(f"k{n}"), F.struct("box", "label", "score").alias(f"__{n}"))
    pairs = overlapping(r, c, "__image", at).join(side(r, "r"), "r").join(side(c, "c"), "c")
    same = F.col("__r.label").eqNullSafe(F.col("__c.label"))
    order = F.struct((-F.col("iou")).alias("d"), (~same).alias("other"), *(F.col(f"__{x}").alias(x.replace(".", "_")) for x in ("c.score", "r.score", "r.box", "c.box", "r.label", "c.label")), "r", "c")
    taken = dominant(pairs.select("__image", "r", "c", "kr", "kc", "iou", same.cast("long").alias("same"), order.alias("order")), "r", "c", "order", "kr", "kc")
    zero = F.lit(0).cast("long")
    counted = [r.select("__image", F.col("k").alias("a"), zero.alias("b"), zero.alias("m"), zero.alias("s"), F.lit(0.0).alias("t")), c.select("__image", zero, "k", zero, zero, F.lit(0.0))]
    counted.append(taken.select("__image", zero, zero, "n", F.col("same") * F.col("n"), F.col("iou") * F.col("n")))
    return reduce(DataFrame.union, counted).groupBy("__image").agg(*(F.sum(x).alias(x) for x in "abmst")).select("__image.image", *"abmst")


def match_detections(reference: DataFrame, candidate: DataFrame, image: str, at: float = 0.5, crowd: int = CROWD) -> DataFrame:
    """image, n_reference, n_candidate, n_matched, mean_iou, class_agreement, as `matched` has them, for images with any number of boxes. Boxes: box, label, score. Pairs with the greatest
    IoU come first, then those of one label, then by the candidate's and the reference's score, null scores last; pairs that are alike in all of these go by box and label. Boxes that are alike
    in all are one with a count, so that copies make no pairs among themselves. Images that are null are one image. Boxes without a positive area count and match nothing.
    Boxes of an image with at most crowd of them are shuffled once, by image, and matched as they come by; only those of crowded images are placed on a grid and written.
    `matched` is the fold for arrays that a row holds already."""
    if not 0 < at <= 1:
        raise ValueError("at must be above 0 and at most 1")

    def rows(df: DataFrame) -> DataFrame:
        score = F.coalesce(-F.col("score").cast("double"), F.lit(float("inf")))
        return df.select(F.col(image).alias("image"), F.col("box").cast("array<double>").alias("box"), "label", score.alias("score"))

    r, c = rows(reference), rows(candidate)
    kinds = dict(r.dtypes)
    plain = kinds["image"] in _PLAIN and kinds["label"] in _PLAIN and kinds["image"] == dict(c.dtypes)["image"] and kinds["label"] == dict(c.dtypes)["label"]
    crowds = materialize(r.select("image").union(c.select("image")).groupBy("image").count().where(F.col("count") > crowd).select(F.col("image").alias("__crowd"), F.lit(True).alias("__is")), "crowds") if plain else None
    total = []
    if plain:
        few = crowds.count() <= 1_000_000
        within = lambda df, how: df.join(F.broadcast(crowds) if few else crowds, F.col("image").eqNullSafe(F.col("__crowd")), how)
        hot = crowds.head() is not None
        corners = [F.when(_extended(F.col("box")), F.get("box", F.lit(i))).alias(x) for i, x in enumerate(("x1", "y1", "x2", "y2"))]
        flat = [(within(df, "left_anti") if hot else df).select("image", F.lit(is_ref).alias("ref"), *corners, "label", "score") for df, is_ref in ((r, True), (c, False))]
        met = flat[0].union(flat[1]).repartition("image").sortWithinPartitions("image")
        total.append(met.mapInArrow(lambda batches: _match_sorted(batches, at), f"image {kinds['image']}, a long, b long, m long, s long, t double"))
        if hot:
            r, c = within(r, "left_semi"), within(c, "left_semi")
    if not plain or hot:
        total.append(_of_crowds(r, c, at))
    return reduce(DataFrame.unionByName, total).select(
        F.col("image").alias(image), F.col("a").cast("int").alias("n_reference"), F.col("b").cast("int").alias("n_candidate"), F.col("m").cast("int").alias("n_matched"),
        F.coalesce(F.try_divide("t", F.col("m").cast("double")), F.lit(0.0)).alias("mean_iou"), F.try_divide("s", "m").alias("class_agreement"),
    )


def sensitivity(out_l2: Column, in_l2: Column) -> tuple[Column, Column]:
    """Ratio of output to input change, and its status."""
    zero_in, zero_out = in_l2 < 1e-12, out_l2 < 1e-12
    status = F.when(zero_in & zero_out, "NO_CHANGE").when(zero_in, "UNSTABLE_WITHOUT_INPUT_CHANGE").when(zero_out, "INSENSITIVE").otherwise("MEASURED")
    return F.when(~zero_in, out_l2 / in_l2), status


def replay_status(recorded: Column, replayed: Column, atol: float = 1e-5, rtol: float = 1e-3) -> dict[str, Column]:
    """Greatest absolute and relative error, number of elements beyond atol + rtol * |recorded|, status."""
    pairs = F.zip_with(recorded, replayed, lambda r, c: F.struct(r.alias("r"), c.alias("c")))
    gap = F.transform(pairs, lambda p: F.abs(p["c"] - p["r"]))
    off = F.size(F.filter(pairs, lambda p: F.coalesce(F.abs(p["c"] - p["r"]) > atol + rtol * F.abs(p["r"]), F.lit(True)))).cast("long")
    relative = F.transform(pairs, lambda p: F.abs(p["c"] - p["r"]) / F.greatest(F.abs(p["r"]), F.lit(1e-12)))
    worst = F.array_max(gap)
    status = (
        F.when(recorded.isNull(), "RECORD_MISSING").when(replayed.isNull(), "REPLAY_MISSING").when(F.size(recorded) != F.size(replayed), "SHAPE_MISMATCH")
        .when(F.exists(replayed, lambda x: ~_finite(x)), "NON_FINITE").when(worst == 0, "EXACT_MATCH").when(off == 0, "WITHIN_TOLERANCE").otherwise("MISMATCH")
    )
    return {"max_abs": worst, "max_relative": F.array_max(relative), "n_off": off, "status": status}


def stage_rollup(stages: DataFrame, key: str) -> DataFrame:
    """key, status, failed: the worst of its stages (stage, status) decides."""
    order = F.array(*(F.lit(s) for s in ("VERIFIED", "UNVERIFIABLE", "INCOMPLETE", "FAILED")))
    rank = F.coalesce(F.nullif(F.array_position(order, F.col("status")), F.lit(0)), F.lit(3))
    g = stages.groupBy(key).agg(F.max(rank).alias("r"), F.array_sort(F.collect_list(F.when(F.col("status") == "FAILED", F.col("stage")))).alias("failed"), F.count("*").alias("n_stages"))
    return g.select(key, F.element_at(order, F.col("r").cast("int")).alias("status"), "failed", "n_stages")


def confidence_interval(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    half = z * F.sqrt(p * (1 - p) / n)
    return clamp(p - half), clamp(p + half)
