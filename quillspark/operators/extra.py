"""Smaller operators: generators, curves, grids, splits and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.evaluation import before_in_order
from quillspark.operators.sequence import so_far, whole, with_steps

#: Fixed values of the generator x -> (9301 x + 49297) mod 233280.
FACTOR, STEP, MODULUS, SEED = 9301, 49297, 233280, 42


def generator_value(k: Column, seed: int = SEED) -> Column:
    """The generator's k-th value, by squaring: each row finds its own without walking from the start."""
    start = F.struct(F.lit(seed).cast("long").alias("x"), F.lit(FACTOR).cast("long").alias("a"), F.lit(STEP).cast("long").alias("c"))

    def halve(s, bit):
        on = F.getbit(k.cast("long"), bit.cast("int")) == 1
        return F.struct(F.when(on, (s.x * s.a + s.c) % MODULUS).otherwise(s.x).alias("x"), ((s.a * s.a) % MODULUS).alias("a"), ((s.a * s.c + s.c) % MODULUS).alias("c"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(40)), start, halve)["x"]


def initial_place(k: Column, seed: int = SEED) -> Column:
    return (generator_value(k, seed) / MODULUS - 0.5) * 20


def roc_curves(predictions: DataFrame) -> DataFrame:
    """``class, s, tpr, fpr``: rates at each score of every class against the others, a row per prediction and class; counts per
    score and per bin of scores come before the sums."""
    rows = predictions.select("target", F.posexplode("p").alias("class", "s"))
    rows = rows.select("class", F.round("s", 9).alias("s"), (F.col("target") == F.col("class")).cast("long").alias("y"))
    steps = rows.groupBy("class", "s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"), F.count("*").cast("int").alias("n"))
    ranked = before_in_order(before_in_order(steps, "pos", ["class"]).withColumnRenamed("before", "pos_before"), "neg", ["class"]).withColumnRenamed("before", "neg_before")
    totals = steps.groupBy("class").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    rate = lambda all_, before: F.when(F.col(all_) > 0, (F.col(all_) - F.col(before)) / F.col(all_))
    out = ranked.join(F.broadcast(totals), "class").select("class", "s", "n", rate("all_pos", "pos_before").alias("tpr"), rate("all_neg", "neg_before").alias("fpr"))  # a row for each class
    return out.select("class", "s", "tpr", "fpr", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("one")).drop("one")


def training_sequence(points: DataFrame) -> DataFrame:
    """``velocity`` (0 where no time passes) and ``elapsed`` since the stroke's first point."""
    p = with_steps(points)
    return p.withColumns({"velocity": F.when(F.col("dt") > 0, F.col("ds") / F.col("dt")).otherwise(0.0), "elapsed": F.col("time") - F.first("time").over(so_far())})


def random_split(rows: DataFrame, validation: float = 0.2, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Unstratified parts by the order of a digest: row counts by bucket give each row its place, so nothing is sorted whole.

    A digest's first two hexadecimal digits are its bucket; rows are ranked within their bucket, after the buckets before.
    """
    keyed = rows.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))).withColumn("bucket", F.substring("shuffle_key", 1, 2))
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n_here"))
    ahead = F.coalesce(F.sum("n_here").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("bucket", ahead.alias("ahead"), F.sum("n_here").over(Window.partitionBy()).alias("n"))  # 256 rows at most
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("shuffle_key", "id"))
    ranked = keyed.withColumn("place", place).join(F.broadcast(starts), "bucket").withColumn("place", F.col("place") + F.col("ahead"))
    first = F.floor(F.col("n") * (1 - F.lit(validation) - F.lit(test)))
    second = first + F.floor(F.col("n") * validation)
    return ranked.withColumn("part", F.when(F.col("place") <= first, "train").when(F.col("place") <= second, "validation").otherwise("test")).drop("shuffle_key", "bucket", "place", "ahead", "n")


def flux(spectra: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rises of the power at each place from ``other`` to ``stroke_id``, added up, for each of the pairs of strokes: equi-joins on
    stroke and place."""
    was = spectra.select(F.col("stroke_id").alias("other"), "k", F.col("power").alias("was"))
    both = pairs.join(spectra.select("stroke_id", "k", "power"), "stroke_id").join(was, ["other", "k"])
    return both.groupBy("stroke_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("power") - F.col("was"))).alias("flux"))


def normalised_arc(points: DataFrame, col: str = "sigma") -> DataFrame:
    top = F.max(col).over(whole())
    return points.withColumn("top", top).withColumn(col, F.when(F.col("top") == 0, 0.0).otherwise(F.col(col) / F.col("top"))).drop("top")


def density_grid(points: DataFrame, cells: int) -> DataFrame:
    """Points less than one cell from each grid place on both axes, where there are more than one; each point names its
    places, so no grid is joined."""
    near = lambda c: F.explode(F.filter(F.sequence(F.floor(F.col(c) * cells).cast("int"), F.ceil(F.col(c) * cells).cast("int")), lambda g: F.abs(F.col(c) * cells - g) < 1))
    placed = points.select("stroke_id", "x", "y", near("x").alias("gx")).select("stroke_id", "gx", near("y").alias("gy"))
    return placed.groupBy("stroke_id", "gx", "gy").agg(F.count("*").alias("n")).where("n > 1")


def density_cloud(points: DataFrame, size: float = 2.0, most: int = 100) -> DataFrame:
    """``stroke_id, gx, gy, gz, density``: the first ``most`` places, by x, y and z, of a grid that starts at the least corner of
    each stroke's box, less than ``size`` from which on all axes there is more than one point (x, y, z); the density is their share."""
    axes = "xyz"
    boxes = points.groupBy("stroke_id").agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in axes for name, f in (("low", F.min), ("high", F.max))))
    placed = points.select("stroke_id", *axes).join(boxes, "stroke_id")

    def near(c: str) -> Column:
        at, low = (F.col(c) - F.col(f"low_{c}")) / size, F.col(f"low_{c}")
        steps = F.sequence(F.greatest(F.lit(0), F.floor(at).cast("int") - 1), F.ceil(at).cast("int") + 1)
        return F.explode(F.filter(steps, lambda k: (F.abs(F.col(c) - (low + k * size)) < size) & (low + k * size <= F.col(f"high_{c}"))))

    for c in axes:
        placed = placed.withColumn(f"k{c}", near(c))
    cells = placed.groupBy("stroke_id", *(f"k{c}" for c in axes)).agg(F.count("*").alias("here"), F.any_value("n").alias("n"), *(F.any_value(f"low_{c}").alias(f"low_{c}") for c in axes)).where("here > 1")
    first = cells.withColumn("place", F.row_number().over(Window.partitionBy("stroke_id").orderBy("kx", "ky", "kz"))).where(F.col("place") <= most)
    return first.select("stroke_id", *((F.col(f"low_{c}") + F.col(f"k{c}") * size).alias(f"g{c}") for c in axes), (F.col("here") / F.col("n")).alias("density"))


def run_times(rows: DataFrame, by: str, value: str, limit: float) -> DataFrame:
    """Mean, upper median and share of runs within the limit.  The median is read from counts by value, not from a list."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col(value)))
    out = ranked.groupBy(by).agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), middle.alias("median"), (F.sum(F.when(F.col(value) <= limit, F.col("n")).otherwise(0)) / F.sum("n")).alias("on_time"))
    return out.select(by, "mean", "median", "on_time")


def ranked_by_id(rows: DataFrame, id_col: str, width: int = 4096) -> DataFrame:
    """``place`` from 0 in the order of a whole-number id: rows before its range of ``width`` ids, plus its rank within it."""
    ranged = rows.withColumn("id_range", F.floor(F.col(id_col) / width))
    counts = ranged.groupBy("id_range").agg(F.count("*").alias("here"))
    ahead = F.coalesce(F.sum("here").over(Window.orderBy("id_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    own = F.row_number().over(Window.partitionBy("id_range").orderBy(id_col)) - 1
    return ranged.join(counts.select("id_range", ahead.alias("ahead")), "id_range").withColumn("place", F.col("ahead") + own).drop("id_range", "ahead")


def quarter_points(points: DataFrame) -> DataFrame:
    """The points at a quarter, half and three quarters of each stroke, each less stable than the one before."""
    n = F.count("*").over(whole())
    p = points.withColumn("n", n).withColumn("q", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where(F.col("i") == F.floor(F.col("n") * F.col("q") / 4))
    return p.select("stroke_id", "i", "q", (0.7 - 0.1 * F.col("q")).alias("stability"))


