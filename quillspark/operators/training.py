"""Training tables: fixed shapes of vectors and sequences, and their augmentation by draws that depend on ids alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.sequence import never_back

LENGTH, WIDTH = 200, 5


def draw(*keys: Column) -> Column:
    """A number over 0 and under 1 from 48 bits of a digest of the keys: the same in every run and on every machine."""
    digest = F.md5(F.concat_ws(":", *(k.cast("string") for k in keys)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 48))


def between(low: float, high: float, *keys: Column) -> Column:
    return low + (high - low) * draw(*keys)


def normal(*keys: Column) -> Column:
    """A standard normal number, from two draws."""
    return F.sqrt(-2 * F.ln(draw(*keys, F.lit("r")))) * F.cos(2 * math.pi * draw(*keys, F.lit("a")))


def feature_matrix(rows: DataFrame, features: str, labels: list[str] | None = None) -> DataFrame:
    """Rows of the labels (none given: all) with vectors padded by zeros to the longest of them."""
    kept = rows.where(F.col("label").isin(labels)) if labels else rows
    longest = kept.agg(F.coalesce(F.max(F.size(features)), F.lit(0)).alias("longest"))
    padded = F.slice(F.concat(features, F.array_repeat(F.lit(0.0), F.col("longest"))), F.lit(1), F.greatest("longest", F.lit(1)))
    return kept.crossJoin(F.broadcast(longest)).withColumn(features, padded).drop("longest")  # one row


def fixed_sequences(points: DataFrame, length: int = LENGTH) -> DataFrame:
    """``stroke_id, sequence``: the first ``length`` points as rows (x, y, pressure, velocity, elapsed), zero rows after the last."""
    row = F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in ("x", "y", "pressure", "velocity", "elapsed")))
    rows = points.where(F.col("i") < length).groupBy("stroke_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", row.alias("r")))), lambda s: s["r"]).alias("rows"))
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), WIDTH), length)
    return rows.select("stroke_id", F.slice(F.concat("rows", zero), 1, length).alias("sequence"))


def augmented_features(rows: DataFrame, features: str = "features", seed: str = "augment", key: str = "id") -> DataFrame:
    """Vectors with noise of a twentieth of their deviation (three rows of ten), the first ten numbers scaled (three of ten), and
    one number of ten set to 0 (two of ten)."""
    s, id_col, v = F.lit(seed), F.col(key), F.col(features)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    n = F.size(v)
    mean = total(v) / n
    deviation = F.sqrt(total(F.transform(v, lambda x: (x - mean) * (x - mean))) / F.greatest(n - 1, F.lit(1)))
    scale = F.when(draw(s, id_col, F.lit("scale?")) < 0.3, between(0.9, 1.1, s, id_col, F.lit("scale"))).otherwise(1.0)
    noise = F.when(draw(s, id_col, F.lit("noise?")) < 0.3, 0.05 * deviation).otherwise(0.0)
    drops = draw(s, id_col, F.lit("drop?")) < 0.2
    out = rows.withColumns({"noise_": noise, "scale_": scale, "drops_": drops})
    changed = F.transform(v, lambda x, k: F.when(F.col("drops_") & (draw(s, id_col, F.lit("drop"), k) <= 0.1), 0.0).otherwise((x + F.col("noise_") * normal(s, id_col, k)) * F.when(k < 10, F.col("scale_")).otherwise(1.0)))
    return out.withColumn(features, changed).drop("noise_", "scale_", "drops_")


def augmented_sequences(points: DataFrame, seed: str = "augment") -> DataFrame:
    """Points moved (four strokes of ten), scaled (four) and turned (three) as a whole, and times jittered without running back
    (three)."""
    s, own = F.lit(seed), F.col("stroke_id")
    chance = lambda name, share, value, other: F.when(draw(s, own, F.lit(f"{name}?")) < share, value).otherwise(other)
    part = lambda low, high, name: between(low, high, s, own, F.lit(name))
    p = points.withColumns({"move_x": chance("move", 0.4, part(-20.0, 20.0, "x"), 0.0), "move_y": chance("move", 0.4, part(-20.0, 20.0, "y"), 0.0), "scale": chance("scale", 0.4, part(0.8, 1.2, "scale"), 1.0), "angle": chance("turn", 0.3, part(-0.2, 0.2, "angle"), 0.0)})
    p = p.withColumns({"x": (F.col("x") + F.col("move_x")) * F.col("scale"), "y": (F.col("y") + F.col("move_y")) * F.col("scale")})
    p = p.withColumns({"x": F.cos("angle") * F.col("x") - F.sin("angle") * F.col("y"), "y": F.sin("angle") * F.col("x") + F.cos("angle") * F.col("y")})
    jittered = F.col("time") + chance("jitter", 0.3, 0.01 * normal(s, own, F.col("i")), 0.0)
    return never_back(p.withColumn("time", jittered)).drop("move_x", "move_y", "scale", "angle")


def of_train_part(rows: DataFrame, split: DataFrame, part: str = "train", key: str = "id") -> DataFrame:
    """Rows of one part of a split, by their ids rather than by places in a list."""
    return rows.join(split.where(F.col("part") == part).select(key), key, "left_semi")


def batches(rows: DataFrame, size: int, key: str = "id", seed: str = "batch", buckets: int = 256) -> DataFrame:
    """``batch``: numbers of batches of ``size`` rows in an order that a digest gives.

    Rows are ranked within their digest's bucket, after the buckets before, so that nothing is sorted whole.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    keyed = rows.withColumn("order_", digest).withColumn("bucket_", F.conv(F.substring("order_", 1, 2), 16, 10).cast("int"))
    counts = keyed.groupBy("bucket_").agg(F.count("*").alias("here_"))
    ahead = F.coalesce(F.sum("here_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("bucket_", ahead.alias("ahead_"))  # at most ``buckets`` rows
    place = F.col("ahead_") + F.row_number().over(Window.partitionBy("bucket_").orderBy("order_", key)) - 1
    return keyed.join(F.broadcast(starts), "bucket_").withColumn("batch", F.floor(place / size)).drop("order_", "bucket_", "ahead_")


def helix(places: DataFrame, count: int = 100) -> DataFrame:
    """``count`` points on a small helix around each stroke's place (stroke_id, px, py, pz, stability): ``i, x, y, z, weight``."""
    t = F.col("i") / (count - 1)
    p = places.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    weight = F.when(F.coalesce(F.col("stability"), F.lit(0.0)) == 0, 0.5).otherwise(F.col("stability"))
    return p.select("stroke_id", "i", (F.col("px") + 0.1 * F.sin(2 * math.pi * t)).alias("x"), (F.col("py") + 0.1 * F.cos(2 * math.pi * t)).alias("y"), (F.col("pz") + 0.2 * t).alias("z"), weight.alias("weight"))


def mutual_information(rows: DataFrame, features: str, label: str, bins: int = 10) -> DataFrame:
    """``pos, information``: how much each place of the vectors, in equal bins of its range, tells of the label, in bits."""
    long = rows.select(label, F.posexplode(features).alias("pos", "v"))
    span = long.groupBy("pos").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    binned = long.join(F.broadcast(span), "pos")  # a row per place of the vectors
    bin_of = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    cells = binned.groupBy("pos", label, bin_of.alias("bin")).agg(F.count("*").alias("n"))
    total, by_label, by_bin = (F.sum("n").over(Window.partitionBy("pos", *keys)) for keys in ((), (label,), ("bin",)))
    part = cells.withColumn("part", F.col("n") / total * F.log2(F.col("n") * total / (by_label * by_bin)))
    return part.groupBy("pos").agg(F.sum("part").alias("information"))
