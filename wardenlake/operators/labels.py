"""Label noise by confident learning, and label flips. Predictions: sample_id, observed (int), probs (array<double>, one a class)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp, wilson_lower


def argmax(values: Column) -> Column:
    """Place of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def normalize(predictions: DataFrame) -> DataFrame:
    """Probabilities scaled to sum to 1."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return predictions.withColumn("probs", F.when(total > 0, F.transform("probs", lambda x: x / total)).otherwise(F.col("probs")))


def thresholds(predictions: DataFrame, k: int) -> DataFrame:
    """label, t, n for each class: the mean of its probability over the rows observed as it; 1 / k where there are none."""
    own = predictions.groupBy(F.col("observed").alias("label")).agg(F.avg(F.element_at("probs", F.col("observed") + 1)).alias("t"), F.count("*").alias("n"))
    every = predictions.sparkSession.range(k).select(F.col("id").cast("int").alias("label"))
    return every.join(own, "label", "left").select("label", clamp(F.coalesce("t", F.lit(1.0 / k))).alias("t"), F.coalesce("n", F.lit(0)).alias("n"))


def _with_thresholds(predictions: DataFrame, k: int) -> DataFrame:
    """One array of the k thresholds and one of the class sizes beside every row."""
    t = thresholds(predictions, k).agg(F.array_sort(F.collect_list(F.struct("label", "t", "n"))).alias("x")).select(F.transform("x", lambda s: s["t"]).alias("ts"), F.transform("x", lambda s: s["n"]).alias("ns"))
    return predictions.crossJoin(F.broadcast(t))  # one row of k numbers


def confident_counts(predictions: DataFrame, k: int) -> DataFrame:
    """observed, latent, n: a row counts for the class that most exceeds its threshold, or for its own."""
    p = _with_thresholds(predictions, k)
    best = argmax(F.zip_with("probs", "ts", lambda x, t: x - t))
    p = p.withColumn("best", best)
    latent = F.when(F.element_at("probs", F.col("best") + 1) >= F.element_at("ts", F.col("best") + 1), F.col("best")).otherwise(F.col("observed"))
    return p.groupBy("observed", latent.alias("latent")).agg(F.count("*").alias("n"))


def joint_noise(predictions: DataFrame, k: int) -> DataFrame:
    """observed, latent, q: counts over their latent total, times the latent class's prior, scaled to sum to 1 (zero cells are left out)."""
    c = confident_counts(predictions, k)
    prior = predictions.groupBy(F.col("observed").alias("latent")).agg(F.count("*").alias("n_class"))
    col = c.groupBy("latent").agg(F.sum("n").alias("n_col"))
    n = predictions.agg(F.count("*").alias("n_all"))
    raw = c.join(col, "latent").join(prior, "latent", "left").crossJoin(F.broadcast(n)).withColumn("q", F.col("n") / F.col("n_col") * F.coalesce("n_class", F.lit(0)) / F.col("n_all"))
    total = raw.agg(F.sum("q").alias("t"))
    return raw.crossJoin(F.broadcast(total)).select("observed", "latent", (F.col("q") / F.col("t")).alias("q"))


def anomalies(predictions: DataFrame, k: int, min_class: int = 5, discount: float = 0.5, high: float = 0.8, low: float = 0.2, systematic_at: float = 0.15) -> DataFrame:
    """For every row: the best other class, margin, score, confidence and category."""
    p = _with_thresholds(predictions, k)
    masked = F.transform("probs", lambda x, i: F.when(i == F.col("observed"), F.lit(-1.0)).otherwise(x))
    p = p.withColumn("latent", argmax(masked)).withColumn("observed_p", F.element_at("probs", F.col("observed") + 1))
    p = p.withColumn("latent_p", F.element_at("probs", F.col("latent") + 1)).withColumn("n_class", F.element_at("ns", F.col("observed") + 1))
    p = p.withColumn("margin", (F.col("latent_p") - F.element_at("ts", F.col("latent") + 1)) - (F.col("observed_p") - F.element_at("ts", F.col("observed") + 1)))
    pairs = p.where("margin > 0").groupBy("observed", "latent").agg(F.count("*").alias("n_pair"), F.first("n_class").alias("nc")).where(F.col("n_pair") / F.col("nc") >= systematic_at).select("observed", "latent", F.lit(True).alias("systematic"))
    p = p.join(F.broadcast(pairs), ["observed", "latent"], "left")  # k * k rows at most
    raw = clamp(F.least(F.lit(1.0), F.col("n_class") / 20.0) * F.col("latent_p"))
    category = (
        F.when(F.col("n_class") <= 1, "INSUFFICIENT_EVIDENCE").when(F.col("margin") <= 0, "MODEL_DISAGREEMENT").when(F.col("n_class") < min_class, "RARE_CLASS_ANOMALY")
        .when((F.col("latent_p") >= high) & (F.col("observed_p") <= low), "HIGH_CONFIDENCE_ALTERNATIVE_CLASS").when(F.col("systematic"), "CLASS_SYSTEMATIC_ANOMALY").otherwise("POSSIBLE_LABEL_MISMATCH")
    )
    p = p.withColumn("category", category).withColumn("score", 1 / (1 + F.exp(-5.0 * clamp(F.col("margin"), -50.0, 50.0))))
    confidence = F.when(F.col("category") == "INSUFFICIENT_EVIDENCE", 0.0).when((F.col("margin") <= 0) & (F.col("latent_p") <= F.col("observed_p")), 0.0).when(F.col("category") == "RARE_CLASS_ANOMALY", raw * discount).otherwise(raw)
    return p.withColumn("confidence", confidence).drop("ts", "ns", "systematic")


def transitions(predictions: DataFrame) -> DataFrame:
    """observed, latent (plain argmax), n, margin (mean of the likeliest less the observed probability)."""
    best = argmax(F.col("probs"))
    return predictions.groupBy("observed", best.alias("latent")).agg(F.count("*").alias("n"), F.avg(F.array_max("probs") - F.element_at("probs", F.col("observed") + 1)).alias("margin"))


def transition_rates(predictions: DataFrame, k: int) -> DataFrame:
    """observed, latent, n, rate of the whole matrix; the row of a class that nobody observed is the identity."""
    spark = predictions.sparkSession
    cells = spark.range(k * k).select((F.col("id") / k).cast("int").alias("observed"), (F.col("id") % k).cast("int").alias("latent"))
    out = cells.join(transitions(predictions), ["observed", "latent"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = F.sum("n").over(Window.partitionBy("observed"))
    return out.withColumn("row", row).select("observed", "latent", "n", F.when(F.col("row") > 0, F.col("n") / F.col("row")).otherwise((F.col("observed") == F.col("latent")).cast("double")).alias("rate"))


def flips(predictions: DataFrame, k: int, min_class: int = 5, min_count: int = 3, target_n: float = 6.0) -> DataFrame:
    """For each pair of different classes with transitions: rate, asymmetry, noise concentration, targeted flip score, category, confidence."""
    t = transitions(predictions)
    rows = t.groupBy("observed").agg(F.sum("n").alias("n_source"), F.sum(F.when(F.col("observed") == F.col("latent"), F.col("n")).otherwise(0)).alias("n_same"))
    back = t.select(F.col("observed").alias("latent"), F.col("latent").alias("observed"), F.col("n").alias("n_back"))
    out = t.where("observed <> latent").join(rows, "observed").join(back, ["observed", "latent"], "left").withColumn("n_back", F.coalesce("n_back", F.lit(0)))
    out = out.withColumn("rate", F.col("n") / F.col("n_source")).withColumn("asymmetry", (F.col("n") - F.col("n_back")) / (F.col("n") + F.col("n_back")))
    out = out.withColumn("nci", F.col("n") / (F.col("n_source") - F.col("n_same"))).withColumn("discount", F.when(F.col("n") < 3, 0.0).otherwise(1 / (1 + F.exp(-0.5 * (F.col("n") - target_n)))))
    out = out.withColumn("score", clamp(F.col("discount") * F.col("rate") * F.greatest(F.lit(0.0), F.col("asymmetry")) * F.col("nci")))
    lower = wilson_lower(F.col("rate"), F.col("n_source").cast("double"))
    few = (F.col("n_source") < min_class) | (F.col("n") < min_count)
    category = (
        F.when(few, "INSUFFICIENT_SUPPORT").when((F.abs("asymmetry") <= 0.35) & (F.col("n_back") >= min_count), "RECIPROCAL_CLASS_CONFUSION")
        .when((F.col("score") >= 0.40) & (F.col("asymmetry") >= 0.5) & (F.col("nci") >= 0.5), "POSSIBLE_LABEL_FLIP").when(F.col("asymmetry") >= 0.40, "DIRECTIONAL_LABEL_TRANSITION")
        .when(F.col("rate") >= 0.20, "SYSTEMATIC_CLASS_TRANSITION").otherwise("DIRECTIONAL_LABEL_TRANSITION")
    )
    out = out.withColumn("category", category).withColumn("wilson_low", lower)
    c = F.col("category")
    confidence = F.when(c == "INSUFFICIENT_SUPPORT", 0.0).when(c == "RECIPROCAL_CLASS_CONFUSION", F.col("wilson_low") * 0.5).when(c == "POSSIBLE_LABEL_FLIP", F.when(F.col("margin") < 0.2, F.col("wilson_low") * 0.5).otherwise(F.col("wilson_low"))).otherwise(F.col("wilson_low") * F.col("discount"))
    return out.withColumn("confidence", confidence)


def collapses(flipped: DataFrame, least: int = 3) -> DataFrame:
    """Sink classes that at least three classes flip to."""
    return flipped.where("category = 'POSSIBLE_LABEL_FLIP'").groupBy(F.col("latent").alias("sink")).agg(F.countDistinct("observed").alias("n_sources")).where(F.col("n_sources") >= least).select("sink", "n_sources", F.lit(0.8).alias("score"), F.lit(0.85).alias("confidence"))


def contributor_flips(predictions: DataFrame, contributor: str, min_samples: int = 5, min_count: int = 3, at: float = 0.25) -> DataFrame:
    """contributor, observed, latent, rate, baseline (the others'), differential, where it is at least at."""
    p = predictions.select("observed", argmax(F.col("probs")).alias("latent"), F.col(contributor).alias("contributor"))
    own_total = p.groupBy("contributor", "observed").agg(F.count("*").alias("own_total"))
    own = p.where("observed <> latent").groupBy("contributor", "observed", "latent").agg(F.count("*").alias("own"))
    total = own_total.groupBy("observed").agg(F.sum("own_total").alias("total"))
    pair = own.groupBy("observed", "latent").agg(F.sum("own").alias("pair"))
    out = own.join(own_total, ["contributor", "observed"]).join(total, "observed").join(pair, ["observed", "latent"]).where((F.col("own_total") >= min_samples) & (F.col("own") >= min_count))
    out = out.withColumn("rate", F.col("own") / F.col("own_total")).withColumn("baseline", (F.col("pair") - F.col("own")) / F.greatest(F.lit(1), F.col("total") - F.col("own_total")))
    return out.withColumn("differential", F.col("rate") - F.col("baseline")).where(F.col("differential") >= at)


def stratified_folds(samples: DataFrame, label: str, sample_id: str, k: int = 5, seed: str = "42") -> DataFrame:
    """samples with fold: within each label round robin in the order of sha256(id:seed)."""
    w = Window.partitionBy(label).orderBy(F.sha2(F.concat_ws(":", F.col(sample_id).cast("string"), F.lit(seed)), 256), sample_id)
    return samples.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def out_of_fold_centroids(samples: DataFrame, vector: str, label: str, fold: str = "fold", temperature: float = 10.0, k: int = 10) -> DataFrame:
    """samples with probs: softmax of cosine similarities to class centroids fitted on the other folds (vectors scaled to length 1).

    Sums by fold, class and dimension are one aggregation; a fold's centroids are the totals less its own sums."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = samples.withColumn("__u", F.transform(vector, lambda x: x.cast("double") / norm))
    sums = unit.select(fold, label, F.posexplode("__u").alias("i", "x")).groupBy(fold, label, "i").agg(F.sum("x").alias("s"))
    total = sums.groupBy(label, "i").agg(F.sum("s").alias("t"))
    folds = sums.select(fold).distinct()
    rest = folds.crossJoin(F.broadcast(total.withColumnRenamed(label, "__c"))).join(sums.withColumnRenamed(label, "__c"), [fold, "__c", "i"], "left").withColumn("d", F.col("t") - F.coalesce("s", F.lit(0.0)))
    c = rest.groupBy(fold, "__c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda s: s["d"]).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    c = c.withColumn("v", F.transform("v", lambda x: x / length))
    table = c.groupBy(fold).agg(F.transform(F.array_sort(F.collect_list(F.struct("__c", "v"))), lambda s: s["v"]).alias("__centroids"))
    out = unit.join(F.broadcast(table), fold)  # folds x classes x dimensions numbers
    cos = F.transform("__centroids", lambda v: F.aggregate(F.zip_with(v, "__u", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
    out = out.withColumn("__e", F.transform(cos, lambda s: F.exp(s * temperature)))
    return out.withColumn("probs", F.transform("__e", lambda e: e / F.aggregate("__e", F.lit(0.0), lambda a, x: a + x))).drop("__u", "__e", "__centroids")
