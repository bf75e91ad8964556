"""The whole analysis of strokes in one call: what the other modules measure, a row for each stroke."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import features, geometry, homology, sequence, signature, spectral
from quillspark.operators.sequence import whole
from quillspark.state import plain_unions

#: What an analysis may be made of; the first two always run.
PARTS = ("preprocessing", "curvature", "affine", "path_signature", "topology", "knot", "spectral")
MOST_POINTS, CROWDED, CROWDED_POINTS = 100, 200, 75


def thinned(points: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """Each stroke in the unit square; of one with more than ``most`` points every k-th, places counted anew.

    Strokes of over 200 points keep at most 75.
    """
    box = geometry.unit_square(points).withColumn("n", F.count("*").over(whole()))
    limit = F.when(F.col("n") > CROWDED, min(most, CROWDED_POINTS)).otherwise(most)
    step = F.ceil(F.col("n") / limit)
    kept = box.where((F.col("n") <= limit) | (F.col("i") % step == 0))
    return kept.withColumn("i", F.when(F.col("n") > limit, F.floor(F.col("i") / step)).otherwise(F.col("i")).cast("int")).drop("n")


def crowded(points: DataFrame) -> DataFrame:
    """``stroke_id, n, crowded``: strokes too long for topology and knots."""
    return points.groupBy("stroke_id").agg(F.count("*").alias("n")).withColumn("crowded", F.col("n") > CROWDED)


def analyse(points: DataFrame, parts: tuple[str, ...] = PARTS, most: int = MOST_POINTS) -> DataFrame:
    """A row for each stroke.  Parts that are left out, or that a crowded stroke does not
    get, are null in its row.

    The points are dealt by stroke once; every part groups and joins by stroke, so none shuffles again.
    """
    plain_unions(points.sparkSession)
    dealt = points.repartition("stroke_id")
    own = crowded(dealt)
    p = thinned(dealt, most)
    curved = sequence.curvature_metrics(p).select("stroke_id", "complexity", (1 - F.least(F.lit(1.0), F.col("variance"))).alias("regularity"))
    steady = features.stability_index(features.landmarks(p)).select("stroke_id", F.col("stability").alias("stability_index"), F.col("n").alias("n_landmarks"))
    tables = [own, curved, steady, geometry.symmetry(p)]
    if "affine" in parts:
        length = sequence.affine_arc(p).groupBy("stroke_id").agg(F.max("sigma").alias("affine_length"))
        kappa = sequence.affine_curvature(p).groupBy("stroke_id").agg(F.avg("kappa").alias("mean_kappa"), F.stddev_pop("kappa").alias("deviation_kappa"), F.max(F.abs("kappa")).alias("max_kappa"))
        tables += [length, kappa]
    if "path_signature" in parts:
        tables.append(signature.path_signature(p))
    if "topology" in parts:
        tables.append(homology.metrics(p.join(own.where("not crowded").select("stroke_id"), "stroke_id")).select("stroke_id", "b0", "b1", "total", "euler"))
    if "knot" in parts:
        knots = features.knot_metrics(p.join(own.where("not crowded").select("stroke_id"), "stroke_id"))
        tables.append(knots.select("stroke_id", "writhe", "winding", "total_turning", "n_crossings"))
    if "spectral" in parts:
        power = spectral.spectrum(spectral.tangent_signal(p))
        first = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") < 8, F.struct("k", "power")))), lambda s: F.sqrt(s["power"]))
        tables += [spectral.moments(power).select("stroke_id", "centroid"), power.groupBy("stroke_id").agg(first.alias("magnitudes"))]
    return reduce(lambda a, b: a.join(b, "stroke_id", "left"), tables)


def of_drawing(found: DataFrame) -> DataFrame:
    """Means over all strokes of ``analyse``'s scores, with totals of strokes and points."""
    return found.agg(F.count("*").alias("n_strokes"), F.sum("n").alias("n_points"), F.avg("complexity").alias("complexity"), F.avg("regularity").alias("regularity"), F.avg("symmetry").alias("symmetry"))


def quality(elapsed: Column, n_points: Column, n_parts: Column, target: float = 100.0, most: int = MOST_POINTS) -> Column:
    """.4 for time within the target, .4 for parts run of seven, .2 for points read, from 0 to 1."""
    time = F.when(elapsed <= target, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (elapsed - target) / target))
    score = 0.4 * time + 0.4 * n_parts / len(PARTS) + 0.2 * F.least(F.lit(1.0), n_points / most)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def comprehensive(found: DataFrame) -> DataFrame:
    """The 50 numbers of a stroke that a neighbour graph is built on, from ``analyse``'s columns; null counts as 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    head = [zero(c) for c in ("affine_length", "total_turning", "winding", "writhe", "b0", "b1")] + [F.lit(0.0)] + [zero(c) for c in ("complexity", "regularity", "symmetry", "stability_index")]
    blocks = [F.slice(c, 1, k) for c, k in (("level1", 2), ("level2", 4), ("log_signature", 4))]
    return found.select("stroke_id", F.slice(F.concat(F.array(*head), *blocks, F.array(zero("mean_kappa"), zero("deviation_kappa"), zero("max_kappa")), F.col("magnitudes"), F.array_repeat(F.lit(0.0), 50)), 1, 50).alias("features"))
