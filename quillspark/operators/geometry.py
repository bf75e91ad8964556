"""Normalisation, resampling, shape scores and the three-dimensional signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from quillspark.operators.sequence import after, arc_length, before, step, turn_curvature, velocity, whole, with_steps


def unit_square(points: DataFrame, by: WindowSpec | None = None) -> DataFrame:
    """x and y brought into [0, 1] by the box of each stroke (or window ``by``); a side of no extent counts as 1."""
    by = by or whole()
    low = {c: F.min(c).over(by) for c in "xy"}
    span = {c: F.max(c).over(by) - F.min(c).over(by) for c in "xy"}
    out = points.withColumns({f"low_{c}": low[c] for c in "xy"} | {f"span_{c}": span[c] for c in "xy"})
    return out.withColumns({c: (F.col(c) - F.col(f"low_{c}")) / F.when(F.col(f"span_{c}") == 0, 1.0).otherwise(F.col(f"span_{c}")) for c in "xy"}).drop(*(f"{k}_{c}" for k in ("low", "span") for c in "xy"))


def joint_square(points: DataFrame, drawing: str) -> DataFrame:
    """x and y brought into [0, 1] by one box for all strokes of a ``drawing``; a side of no extent counts as 1.

    The boxes are aggregated and joined back, so that a drawing of any size is spread over many tasks.
    """
    boxes = points.groupBy(drawing).agg(*(f(c).alias(f"{name}_{c}") for c in "xy" for name, f in (("low", F.min), ("high", F.max))))
    out = points.join(boxes.withColumnRenamed(drawing, "of_"), F.col(drawing).eqNullSafe(F.col("of_")))
    span = lambda c: F.col(f"high_{c}") - F.col(f"low_{c}")
    return out.withColumns({c: (F.col(c) - F.col(f"low_{c}")) / F.when(span(c) == 0, 1.0).otherwise(span(c)) for c in "xy"}).drop("of_", *(f"{n}_{c}" for n in ("low", "high") for c in "xy"))


def decimate(points: DataFrame, most: int = 100) -> DataFrame:
    """Every k-th point, k the least that leaves ``most`` or fewer; the last point may go."""
    return points.withColumn("stride", F.ceil(F.count("*").over(whole()) / most)).where("i % stride = 0").drop("stride")


def catmull_rom(points: DataFrame, target: int) -> DataFrame:
    """The curve through the points, sampled max(1, target // segments) times a segment; below four points unchanged."""
    p = points.withColumns({"n": F.count("*").over(whole())} | {f"{c}{k}": v for c in ("x", "y") for k, v in (("a", F.coalesce(before(c), F.col(c))), ("b", after(c)), ("d", F.coalesce(after(c, 2), after(c))))} | {"tb": after("time")})
    per = F.when(F.col("n") < 4, 1).otherwise(F.greatest(F.lit(1), F.floor(target / (F.col("n") - 1)))).cast("int")
    p = p.withColumn("per", F.when(F.col("tb").isNull(), 1).otherwise(per))
    p = p.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("per") - 1))).withColumn("t", F.col("j") / F.col("per"))

    def curve(c: str) -> str:
        return f"case when tb is null or n < 4 or j = 0 then {c} else 0.5 * (2 * {c} + ({c}b - {c}a) * t + (2 * {c}a - 5 * {c} + 4 * {c}b - {c}d) * t * t + (3 * {c} - {c}a - 3 * {c}b + {c}d) * t * t * t) end"

    return p.selectExpr("stroke_id", "i as segment", "j", f"{curve('x')} as x", f"{curve('y')} as y", "case when tb is null then time else time + t * (tb - time) end as time")


def resample(points: DataFrame, target: int) -> DataFrame:
    """``target`` points at equal steps of arc length; strokes with no more points than that are left as they are.

    A wanted length lies in the first segment that ends at or after it: each segment gives the points it holds, so there is
    no join of lengths with segments.  A stroke of no length gives its first point again and again, and its last one at the
    end.  Where the points have a pressure, it goes from a segment's start to its end, where a missing or zero one counts as 1;
    a segment that starts without any gives none.
    """
    pressed = "pressure" in points.columns
    p = arc_length(points).withColumns({"n": F.count("*").over(whole()), "total": F.max("arc").over(whole()), "arc_a": before("arc"), "xa": before("x"), "ya": before("y"), "ta": before("time")})
    kept = ["x", "y", "time"]
    if pressed:
        p, kept = p.withColumn("pa", before("pressure")), [*kept, "pressure"]
    few = p.where(F.col("n") <= target).select("stroke_id", F.col("i").alias("k"), *kept)
    gap = F.col("total") / (target - 1)
    longer = p.where(F.col("n") > target)
    many = longer.where(F.col("i") >= 1).withColumn("gap", gap)
    low = F.when(F.col("i") == 1, F.lit(0)).otherwise(F.floor(F.col("arc_a") / F.col("gap")).cast("int"))
    high = F.ceil(F.col("arc") / F.col("gap")).cast("int")
    many = many.where("gap > 0").withColumn("k", F.explode(F.sequence(low, F.least(high, F.lit(target - 1))))).withColumn("want", F.least(F.col("k") * F.col("gap"), F.col("total")))
    inside = (F.col("want") <= F.col("arc")) & ((F.col("i") == 1) | (F.col("want") > F.col("arc_a")))
    many = many.where(inside).withColumn("t", F.when(F.col("arc") > F.col("arc_a"), (F.col("want") - F.col("arc_a")) / (F.col("arc") - F.col("arc_a"))).otherwise(0.0))
    forms = ["xa + t * (x - xa) as x", "ya + t * (y - ya) as y", "ta + t * (time - ta) as time"]
    if pressed:
        own = "when i = 1 and k = 0 then pa when k = " + str(target - 1) + " then pressure when pa is null or pa = 0 then null"
        forms.append(f"case {own} else pa + t * (coalesce(nullif(pressure, 0), 1) - pa) end as pressure")
    placed = many.selectExpr("stroke_id", "k", *forms)
    still = longer.where((F.col("total") == 0) & ((F.col("i") == 0) | (F.col("i") == F.col("n") - 1)))
    times = F.when(F.col("i") == 0, F.sequence(F.lit(0), F.lit(target - 2))).otherwise(F.array(F.lit(target - 1)))
    return few.unionByName(placed).unionByName(still.select("stroke_id", F.explode(times).alias("k"), *kept))


def symmetry(points: DataFrame, least: int = 4) -> DataFrame:
    """``stroke_id, symmetry``: mean of exp(-10 d), d from each point's mirror image in x = .5 to the nearest point.

    Each stroke is one row of arrays here, so that no pairs of points are shuffled.
    """
    strokes = points.groupBy("stroke_id").agg(F.collect_list(F.struct("x", "y")).alias("p"))

    def score(a):
        away = F.transform("p", lambda b: step(b.x - (1.0 - a.x), b.y - a.y))
        return F.exp(-10 * F.array_min(away))

    total = F.aggregate(F.transform("p", score), F.lit(0.0), lambda s, v: s + v)
    return strokes.select("stroke_id", F.when(F.size("p") < least, 0.0).otherwise(total / F.size("p")).alias("symmetry"))


def line_crossings(points: DataFrame, lines=(0.25, 0.5, 0.75)) -> DataFrame:
    """``horizontal, vertical``: steps that meet the reference lines, both ends included."""
    p = points.withColumns({"px": before("x"), "py": before("y")}).where("px is not null")
    meets = lambda c, v: (((F.col(f"p{c}") <= v) & (F.col(c) >= v)) | ((F.col(f"p{c}") >= v) & (F.col(c) <= v))).cast("long")
    count = lambda c: F.sum(sum((meets(c, v) for v in lines), F.lit(0).cast("long")))
    return p.groupBy("stroke_id").agg(count("y").alias("horizontal"), count("x").alias("vertical"))


def shape(points: DataFrame) -> DataFrame:
    """Box ratio and centroid of each stroke."""
    height = F.max("y") - F.min("y")
    return points.groupBy("stroke_id").agg(F.when(height > 0, (F.max("x") - F.min("x")) / height).otherwise(1.0).alias("box_ratio"), F.avg("x").alias("center_x"), F.avg("y").alias("center_y"))


def motion_scores(points: DataFrame) -> DataFrame:
    """``complexity`` from curvature and turns, at most 10, and ``regularity`` from the spread of the velocity."""
    p = turn_curvature(velocity(points)).withColumn("tangent", F.atan2("dy", "dx"))
    turn = F.abs(F.col("tangent") - before("tangent"))
    p = p.withColumn("turn", F.least(turn, 2 * 3.141592653589793 - turn))
    rough = F.coalesce(F.sqrt(F.avg(F.col("curvature") * F.col("curvature"))), F.lit(0.0))
    out = p.groupBy("stroke_id").agg(F.least(rough * 10 + F.coalesce(F.avg("turn"), F.lit(0.0)), F.lit(10.0)).alias("complexity"), F.avg("velocity").alias("mean"), F.stddev_pop("velocity").alias("spread"))
    return out.select("stroke_id", "complexity", F.when(F.col("mean") > 0, F.greatest(F.lit(0.0), 1 - F.col("spread") / F.col("mean"))).otherwise(0.0).alias("regularity"))


def geometric_complexity(points: DataFrame, bins: int = 10) -> DataFrame:
    """Entropy in bits, over bins up to the largest, of four areas by the product of the sides at inner points."""
    p = points.withColumns({f"{c}{k}": v for c in "xy" for k, v in (("p", before(c)), ("n", after(c)))}).where("xp is not null and xn is not null")
    a, b, c = step(F.col("xp") - F.col("x"), F.col("yp") - F.col("y")), step(F.col("x") - F.col("xn"), F.col("y") - F.col("yn")), step(F.col("xn") - F.col("xp"), F.col("yn") - F.col("yp"))
    area = F.abs((F.col("x") - F.col("xp")) * (F.col("yn") - F.col("yp")) - (F.col("xn") - F.col("xp")) * (F.col("y") - F.col("yp"))) / 2
    p = p.withColumn("bend", F.when((area > 0) & (a * b * c > 0), 4 * area / (a * b * c)).otherwise(0.0)).withColumn("top", F.max("bend").over(whole()))
    counts = p.where("top > 0").withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("bend") / F.col("top") * bins))).groupBy("stroke_id", "bin").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(whole())
    found = counts.withColumn("h", -share * F.log2(share)).groupBy("stroke_id").agg(F.sum("h").alias("entropy"))
    return points.select("stroke_id").distinct().join(found, "stroke_id", "left").select("stroke_id", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def spatial_signature(points: DataFrame, drawing: DataFrame, invariants: DataFrame | None = None) -> DataFrame:
    """Each point's place in three dimensions and its weight.

    ``drawing`` has a row per stroke with ``crossings, complexity, regularity, spectral_centroid, symmetry``; ``invariants``
    (stroke_id, idx, stability), if given, raise the weight of points less than three places away.
    """
    p = turn_curvature(velocity(unit_square(points))).withColumns({"tangent": F.atan2("dy", "dx"), "bend": F.coalesce(F.col("curvature"), F.lit(0.0)), "last": F.max("i").over(whole())}).join(drawing, "stroke_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    x = F.abs("bend") * 5 + F.col("complexity") * 0.5 + F.col("crossings") / 10 * 0.3 + F.col("x") * 2
    y = F.col("y") * 4 + F.least(zero("velocity") * 1000, F.lit(2.0)) + F.col("i") / F.greatest("last", F.lit(1)) * 2 + F.col("regularity")
    z = (F.sin(zero("tangent")) + 1) * 2 + F.col("spectral_centroid") * 0.5 + F.col("symmetry") * 2 + (F.col("x") + F.col("y")) * 0.5
    out = p.select("stroke_id", "i", (x * 2).alias("sx"), (y * 2).alias("sy"), (z * 2).alias("sz"))
    if invariants is None:
        return out.withColumn("weight", F.lit(0.1))
    near = invariants.select("stroke_id", "stability", "idx", F.explode(F.array(*(F.lit(k) for k in (-2, -1, 0, 1, 2)))).alias("off"))
    near = near.select("stroke_id", (F.col("idx") + F.col("off")).cast("int").alias("i"), (F.col("stability") * (3 - F.abs("off")) / 3).alias("w")).groupBy("stroke_id", "i").agg(F.max("w").alias("w"))
    return out.join(near, ["stroke_id", "i"], "left").withColumn("weight", F.greatest(F.lit(0.1), F.coalesce("w", F.lit(0.1)))).drop("w")


def spatial_metrics(signature: DataFrame) -> DataFrame:
    """Mean distance from the centroid, and a constant by it, of each stroke's signature."""
    mean = {c: F.avg(c).over(whole()) for c in ("sx", "sy", "sz")}
    p = signature.withColumns({f"m{c}": v for c, v in mean.items()})
    away = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in mean), F.lit(0.0)))
    out = p.withColumn("away", away).groupBy("stroke_id").agg(F.avg("away").alias("spread"))
    return out.withColumn("separation", F.when(F.col("spread") > 0, 10 / F.col("spread")).otherwise(0.0))
