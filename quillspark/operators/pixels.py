"""Images as rows of pixels (image_id, y, x, v): the steps of a conversion that are sums and joins.

Thinning, which is procedural, runs per image in an Arrow function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.state import dealt


def rasterised(points: DataFrame, size: int = 32) -> DataFrame:
    """Dark pixels where points of the unit square fall: distinct (image_id, y, x)."""
    cell = lambda c: F.least(F.floor(F.col(c) * size), F.lit(size - 1)).cast("int")
    return points.select(F.col("stroke_id").alias("image_id"), cell("y").alias("y"), cell("x").alias("x")).distinct()


def stretched(pixels: DataFrame) -> DataFrame:
    """Intensities stretched to 0..255 and cut to whole numbers; flat images stay."""
    w = Window.partitionBy("image_id")
    p = pixels.withColumns({"low": F.min("v").over(w), "high": F.max("v").over(w)})
    value = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * 255).cast("int")).otherwise(F.col("v"))
    return p.withColumn("v", value).drop("low", "high")


def otsu(pixels: DataFrame) -> DataFrame:
    """``image_id, threshold``: the level that parts the histogram with the largest variance between its sides."""
    counts = pixels.groupBy("image_id", "v").agg(F.count("*").cast("double").alias("n"))
    w = Window.partitionBy("image_id")
    run = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    p = counts.withColumns({"n0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col("v")).over(run), "n_all": F.sum("n").over(w), "s_all": F.sum(F.col("n") * F.col("v")).over(w)})
    p = p.withColumn("n1", F.col("n_all") - F.col("n0")).where("n1 > 0")
    gap = F.col("s0") / F.col("n0") - (F.col("s_all") - F.col("s0")) / F.col("n1")
    between = F.round(F.col("n0") * F.col("n1") * gap * gap, 6)
    return p.withColumn("b", between).groupBy("image_id").agg(F.max_by("v", F.struct("b", -F.col("v"))).alias("threshold"))


def links(ink: DataFrame) -> DataFrame:
    """Pairs of set pixels that touch: each pixel looks at its eight neighbours by an equi-join."""
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)))
    asked = ink.select("image_id", F.col("y").alias("y0"), F.col("x").alias("x0"), F.explode(around).alias("o"))
    asked = asked.select("image_id", "y0", "x0", (F.col("y0") + F.col("o.a")).alias("y"), (F.col("x0") + F.col("o.b")).alias("x"))
    return asked.join(ink, ["image_id", "y", "x"]).select("image_id", "y0", "x0", "y", "x")


def special_pixels(ink: DataFrame, size: int) -> DataFrame:
    """Inner pixels with one neighbour (end) or three and more (junction)."""
    degree = links(ink).groupBy("image_id", F.col("y0").alias("y"), F.col("x0").alias("x")).agg(F.count("*").alias("n"))
    inner = degree.where(f"y between 1 and {size - 2} and x between 1 and {size - 2}")
    return inner.where("n = 1 or n >= 3").select("image_id", "y", "x", F.when(F.col("n") == 1, "end").otherwise("junction").alias("kind"))


def stroke_timing(paths: DataFrame, speed: float = 100.0) -> DataFrame:
    """Times along traced paths (image_id, path, i, x, y): slower in turns, .1 between paths; paths of one point are left out."""
    w = Window.partitionBy("image_id", "path").orderBy("i")
    p = paths.withColumns({"n": F.count("*").over(Window.partitionBy("image_id", "path")), "dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)}).where("n >= 2")
    p = p.withColumns({"ndx": F.lead("dx").over(w), "ndy": F.lead("dy").over(w)})
    size = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * (F.col("ndx") * F.col("ndx") + F.col("ndy") * F.col("ndy")))
    cos = (F.col("dx") * F.col("ndx") + F.col("dy") * F.col("ndy")) / size
    bend = F.when(size > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))) / np.pi).otherwise(0.0)
    dt = F.coalesce(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (speed * (1 - 0.5 * F.coalesce(bend, F.lit(0.0)))), F.lit(0.0))
    gap = F.when((F.col("i") == 0) & (F.dense_rank().over(Window.partitionBy("image_id").orderBy("path")) > 1), 0.1).otherwise(0.0)
    total = F.sum("dt").over(Window.partitionBy("image_id").orderBy("path", "i").rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("dt", dt + gap).select("image_id", "path", "i", "x", "y", total.alias("time"), pressure_profile(F.col("i"), F.col("n")).alias("pressure"))


def pressure_profile(i, n):
    t = F.when(n > 1, i / (n - 1)).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), 0.5 + 0.4 * F.exp(-4 * (t - 0.5) * (t - 0.5))))


def conversion_quality(strokes: DataFrame, ink: DataFrame) -> DataFrame:
    """Score of each image from its stroke points (image_id, path), its skeleton pixels and its strokes' lengths."""
    s = strokes.groupBy("image_id").agg(F.count("*").alias("points"), F.countDistinct("path").alias("paths"))
    k = ink.groupBy("image_id").agg(F.count("*").alias("pixels"))
    j = k.join(s, "image_id", "left")
    one = lambda e: F.least(F.lit(1.0), e)
    score = 0.4 * one(F.col("points") / F.col("pixels")) + 0.3 * one(5 / F.col("paths")) + 0.3 * one(F.col("points") / F.col("paths") / 20)
    return j.select("image_id", F.coalesce(score, F.lit(0.0)).alias("quality"))


def _thin(image: np.ndarray) -> np.ndarray:
    image = np.pad(image.astype(np.int8), 1)
    changed = True
    while changed:
        changed = False
        for phase in (0, 1):
            n, e, s, w = image[:-2, 1:-1], image[1:-1, 2:], image[2:, 1:-1], image[1:-1, :-2]
            ring = [n, image[:-2, 2:], e, image[2:, 2:], s, image[2:, :-2], w, image[:-2, :-2]]
            total = sum(ring)
            turns = sum((a == 0) & (b == 1) for a, b in zip(ring, ring[1:] + ring[:1]))
            sides = (n * e * s == 0) & (e * s * w == 0) if phase == 0 else (n * e * w == 0) & (n * s * w == 0)
            gone = (image[1:-1, 1:-1] == 1) & (total >= 2) & (total <= 6) & (turns == 1) & sides
            if gone.any():
                image[1:-1, 1:-1][gone] = 0
                changed = True
    return image[1:-1, 1:-1]


def skeleton(ink: DataFrame, size: int) -> DataFrame:
    """The pixels that thinning leaves of each image."""

    def run(rows: pa.Table) -> pa.Table:
        image = np.zeros((size, size), bool)
        image[rows.column("y").to_numpy(), rows.column("x").to_numpy()] = True
        y, x = np.nonzero(_thin(image))
        return pa.table({"image_id": pa.array([rows.column("image_id")[0].as_py()] * len(y), pa.int64()), "y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32())})

    return dealt(ink, "image_id").groupBy("image_id").applyInArrow(run, "image_id long, y int, x int")
