"""Data preparation and the scores of predictions (id, target, p, predicted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a score in which running sums are taken first.
BINS = 1024


def shuffle_key(id_col: str, seed: int = 42) -> Column:
    """A fixed order that looks random: a digest of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_split(rows: DataFrame, label: str = "label", train: float = 0.8, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """``part`` train, validation or test; of each label int(n train) and int(n validation) rows, the rest for test."""
    order = Window.partitionBy(label).orderBy("shuffle_key", "id")
    ranked = rows.withColumn("shuffle_key", shuffle_key("id", seed)).withColumns({"place": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy(label))})
    first = F.floor(F.col("n") * train)
    second = first + F.floor(F.col("n") * validation)
    return ranked.withColumn("part", F.when(F.col("place") <= first, "train").when(F.col("place") <= second, "validation").otherwise("test")).drop("shuffle_key", "place", "n")


def label_codes(rows: DataFrame, label: str = "label") -> DataFrame:
    """Codes of the sorted labels from 0: a window over the distinct labels, joined back."""
    codes = rows.select(label).distinct().withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)
    return rows.join(codes, label)


def feature_statistics(rows: DataFrame, features: str) -> DataFrame:
    """Mean, population deviation and range of every place of the vectors."""
    long = rows.select(F.posexplode(features).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    return long.groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.min("v").alias("low"), F.max("v").alias("high"))


def standardised(rows: DataFrame, features: str) -> DataFrame:
    """``scaled``: less the mean, by the population deviation (0 counts as 1).  The statistics are one row."""
    stats = feature_statistics(rows, features).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "deviation"))).alias("stats"))
    scale = lambda v, s: (v.cast("double") - s.mean) / F.when(s.deviation == 0, 1.0).otherwise(s.deviation)
    return rows.join(F.broadcast(stats)).withColumn("scaled", F.zip_with(features, "stats", scale)).drop("stats")  # one row


def padded(features: Column, size: int) -> Column:
    return F.slice(F.concat(features, F.array_repeat(F.lit(0.0), size)), 1, size)


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("target", "predicted").agg(F.count("*").alias("n"))


def class_scores(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class seen; what has no denominator is 0."""
    cells = confusion(predictions)
    sides = cells.select(F.explode(F.array(F.struct(F.col("target").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    sums = sides.groupBy("c").agg(F.sum("t").alias("support"), F.sum("p").alias("claimed"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = sums.select("c", "support", ratio(F.col("hit"), F.col("claimed")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def averages(scores: DataFrame) -> DataFrame:
    """Macro and support-weighted means of the class scores."""
    names = ("precision", "recall", "f1")
    return scores.agg(*(F.avg(n).alias(f"macro_{n}") for n in names), *((F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(f"weighted_{n}") for n in names))


def accuracy(predictions: DataFrame, top: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Accuracy, and share of rows whose class is among the ``top`` likeliest; ties count against the later class."""
    own = F.get("p", F.col("target"))
    ahead = F.size(F.filter("p", lambda q: q > own))
    return predictions.agg(F.avg((F.col("target") == F.col("predicted")).cast("double")).alias("accuracy"), *(F.avg((ahead < k).cast("double")).alias(f"top{k}") for k in top))


def before_in_order(steps: DataFrame, value: str, keys: list[str], score: str = "s", bins: int = BINS) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of equal ``keys`` with a smaller score, of scores in [0, 1].

    Sums of bins come first, so that no key's rows are put in order in one task; a bin's rows are.
    """
    binned = steps.withColumn("score_bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)))
    sums = binned.groupBy(*keys, "score_bin").agg(F.sum(value).alias("of_bin"))
    ahead = F.coalesce(F.sum("of_bin").over(Window.partitionBy(*keys).orderBy("score_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*keys, "score_bin").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = binned.join(sums.select(*keys, "score_bin", ahead.alias("ahead")), [*keys, "score_bin"])
    return joined.withColumn("before", F.col("ahead") + inside).drop("score_bin", "ahead")


def ranking_areas(predictions: DataFrame) -> DataFrame:
    """``c, support, area``: for each class with rows in and outside it, the area under its ROC curve against the others."""
    scores = predictions.select("target", F.posexplode("p").alias("c", "s"))
    steps = scores.groupBy("c", "s").agg(F.count_if(F.col("target") == F.col("c")).alias("pos"), F.count_if(F.col("target") != F.col("c")).alias("neg"))
    wins = before_in_order(steps, "neg", ["c"]).withColumn("wins", F.col("pos") * (F.col("before") + F.col("neg") / 2))
    areas = wins.groupBy("c").agg(F.sum("pos").alias("support"), F.sum("neg").alias("others"), F.sum("wins").alias("wins")).where("support > 0 and others > 0")
    return areas.select("c", "support", (F.col("wins") / (F.col("support") * F.col("others"))).alias("area"))


def weighted_area(areas: DataFrame, most: int = 50) -> DataFrame:
    """The areas' mean weighted by support; null for more than ``most`` classes."""
    return areas.agg(F.when(F.count("*") <= most, F.sum(F.col("area") * F.col("support")) / F.sum("support")).alias("area"))


def report(scores: DataFrame) -> DataFrame:
    """The class scores by name, followed by their plain and weighted means."""
    names = ("precision", "recall", "f1")
    plain = scores.select(F.col("c").cast("string").alias("name"), *names, "support")
    total = F.sum("support").alias("support")
    macro = scores.agg(*(F.avg(n).alias(n) for n in names), total).select(F.lit("macro avg").alias("name"), *names, "support")
    weighted = scores.agg(*((F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names), total).select(F.lit("weighted avg").alias("name"), *names, "support")
    return plain.unionByName(macro).unionByName(weighted)


def evaluation(predictions: DataFrame) -> DataFrame:
    """One row on a whole test set: rows, accuracy, weighted F1, weighted area and mean confidence."""
    own = predictions.agg(F.count("*").alias("n"), F.avg((F.col("target") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg(F.array_max("p")).alias("confidence"))
    f1 = averages(class_scores(predictions)).select(F.col("weighted_f1"))
    return own.crossJoin(f1).crossJoin(weighted_area(ranking_areas(predictions))).select("n", "accuracy", "weighted_f1", "area", "confidence")  # a row each


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Bins [lo, hi) of the confidence: rows, mean confidence and accuracy; a confidence of 1 is in none."""
    rows = predictions.select(F.array_max("p").alias("conf"), (F.col("target") == F.col("predicted")).cast("double").alias("right"))
    return rows.where("conf < 1").groupBy(F.floor(F.col("conf") * bins).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("confidence"), F.avg("right").alias("accuracy"))


def calibration_error(found: DataFrame) -> DataFrame:
    return found.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, t: s + t))


def early_stopping(history: DataFrame, patience: int) -> DataFrame:
    """``since``: epochs since the best so far, of rows (run, epoch, loss); ``stop`` where it reaches the patience."""
    w = Window.partitionBy("run").orderBy("epoch")
    best_so_far = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    improved = history.withColumn("better", (best_so_far.isNull() | (F.col("loss") < best_so_far)))
    last = F.max(F.when(F.col("better"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return improved.withColumn("since", F.col("epoch") - last).withColumn("stop", F.col("since") >= patience)
