"""Operators on the points of a stroke in their order.

All take rows (stroke_id, i, x, y, time) and use one window specification, so that any combination of them costs one
shuffle by stroke.  Those that add a column keep all others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order():
    return Window.partitionBy("stroke_id").orderBy("i")


def so_far():
    return order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole():
    return Window.partitionBy("stroke_id")


def frame(before: int, after: int):
    return order().rowsBetween(-before, after)


def before(col: str, k: int = 1) -> Column:
    return F.lag(col, k).over(order())


def after(col: str, k: int = 1) -> Column:
    return F.lead(col, k).over(order())


def step(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def wrapped(angle: Column) -> Column:
    """An angle difference brought into [-pi, pi]."""
    return F.when(angle > math.pi, angle - 2 * math.pi).when(angle < -math.pi, angle + 2 * math.pi).otherwise(angle)


def with_steps(points: DataFrame) -> DataFrame:
    """``dx, dy, dt`` from the point before, and ``ds``, their length; null at the first point."""
    out = points.withColumns({"dx": F.col("x") - before("x"), "dy": F.col("y") - before("y"), "dt": F.col("time") - before("time")})
    return out.withColumn("ds", step(F.col("dx"), F.col("dy")))


def arc_length(points: DataFrame) -> DataFrame:
    """``arc``: length of the path up to each point, 0 at the first."""
    return with_steps(points).withColumn("arc", F.sum(F.coalesce("ds", F.lit(0.0))).over(so_far()))


def velocity(points: DataFrame) -> DataFrame:
    """``velocity``: step length by elapsed time, the time at least one unit; null at the first point."""
    return with_steps(points).withColumn("velocity", F.col("ds") / F.greatest("dt", F.lit(1.0)))


def acceleration(points: DataFrame) -> DataFrame:
    """``acceleration``: change of velocity by the step's time; null at the first two points."""
    return velocity(points).withColumn("acceleration", (F.col("velocity") - before("velocity")) / F.greatest("dt", F.lit(1.0)))


def turn_curvature(points: DataFrame, signed: bool = True) -> DataFrame:
    """``curvature``: sine of the turn at each inner point, 0 where a step has no length; null at the ends."""
    out = with_steps(points).withColumns({"ndx": after("dx"), "ndy": after("dy"), "nds": after("ds")})
    cross, size = F.col("dx") * F.col("ndy") - F.col("dy") * F.col("ndx"), F.col("ds") * F.col("nds")
    value = F.when(size > 0, cross / size).when(size == 0, F.lit(0.0))
    return out.withColumn("curvature", value if signed else F.abs(value))


def tangent_angle(points: DataFrame) -> DataFrame:
    """``tangent``: direction of the step that ends at each point; null at the first."""
    return with_steps(points).withColumn("tangent", F.atan2("dy", "dx"))


def moving_average(points: DataFrame, window: int = 3) -> DataFrame:
    """x and y averaged over a centred, clipped window; unchanged if it has one row or the stroke fewer than it."""
    half = window // 2
    as_it_is = (F.lit(window) <= 1) | (F.count("*").over(whole()) < window)
    return points.withColumns({c: F.when(as_it_is, F.col(c)).otherwise(F.avg(c).over(frame(half, half))) for c in ("x", "y")})


def gaussian_smooth(points: DataFrame, sigma: float = 1.0) -> DataFrame:
    """x and y under a Gaussian kernel of ceil(3 sigma) points a side, renormalised at the ends."""
    if sigma <= 0:
        return points
    reach = math.ceil(3 * sigma)
    weights = {k: math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)}
    shifted = lambda c, k: (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(order())
    total = sum((F.when(shifted("x", k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    smooth = {c: sum((F.coalesce(shifted(c, k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0)) / total for c in ("x", "y")}
    few = F.count("*").over(whole()) < 3
    return points.withColumns({c: F.when(few, F.col(c)).otherwise(v) for c, v in smooth.items()})


def total_turning(points: DataFrame) -> DataFrame:
    """``stroke_id, total_turning``: sum of the absolute turns; 0 below three points."""
    turns = tangent_angle(points).withColumn("turn", F.abs(wrapped(F.col("tangent") - before("tangent"))))
    return turns.groupBy("stroke_id").agg(F.coalesce(F.sum("turn"), F.lit(0.0)).alias("total_turning"))


def origin_winding(points: DataFrame) -> DataFrame:
    """``stroke_id, winding``: turns of the ray from the origin; 0 below three points."""
    angles = points.withColumn("ray", F.atan2("y", "x"))
    turns = angles.withColumn("swept", wrapped(F.col("ray") - before("ray")))
    return turns.groupBy("stroke_id").agg(F.when(F.count("*") < 3, 0.0).otherwise(F.sum("swept") / (2 * math.pi)).alias("winding"))


def tangent_winding(points: DataFrame) -> DataFrame:
    return tangent_angle(points).groupBy("stroke_id").agg((F.coalesce(F.sum("tangent"), F.lit(0.0)) / (2 * math.pi)).alias("winding"))


def chirality(points: DataFrame) -> DataFrame:
    """Always 0: in the plane the normals whose turn it would average vanish."""
    return points.groupBy("stroke_id").agg(F.lit(0.0).alias("chirality"))


def directions(points: DataFrame) -> DataFrame:
    """``direction``: the quarter that each step points to, with y downwards."""
    degrees = (F.degrees("tangent") + 360) % 360
    named = F.when((degrees >= 315) | (degrees < 45), "→").when(degrees < 135, "↓").when(degrees < 225, "←").otherwise("↑")
    return tangent_angle(points).withColumn("direction", F.when(F.col("tangent").isNotNull(), named))


def angle_changes(points: DataFrame) -> DataFrame:
    change = F.abs(F.col("tangent") - before("tangent"))
    return tangent_angle(points).withColumn("angle_change", F.least(change, 2 * math.pi - change))


# -- curvature as change of direction by length, and what is read from it ----------------------------------------------


def discrete_curvature(points: DataFrame) -> DataFrame:
    """Rows of the inner points with ``c``, their place ``k`` and value by the first difference."""
    out = with_steps(points).withColumns({"ddx": after("dx") - F.col("dx"), "ddy": after("dy") - F.col("dy")})
    size = F.pow(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), 1.5)
    value = F.when(size > 0, (F.col("dx") * F.col("ddy") - F.col("dy") * F.col("ddx")) / size).otherwise(0.0)
    return out.where("ddx is not null").select("stroke_id", "i", (F.col("i") - 1).alias("k"), value.alias("c"))


def robust_curvature(points: DataFrame) -> DataFrame:
    """Median of three of the discrete curvature.  The first row's window reaches two rows ahead, the last has two rows and
    takes the larger."""
    rows = discrete_curvature(points)
    here, back, ahead, ahead2 = F.col("c"), before("c"), after("c"), after("c", 2)
    window = F.when(F.col("k") == 0, F.array(here, ahead, ahead2)).otherwise(F.array(back, here, ahead))
    ordered = F.array_sort(F.array_compact(window))
    return rows.withColumn("c", F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")))


def local_polynomial(points: DataFrame) -> DataFrame:
    """Twice the quadratic coefficient over five points, by the published sums; rows 2 to n-3.

    The sums are of powers of x less that of the point itself, so that nothing large cancels.
    """
    near = {f"u{k}": ((before("x", -k) if k < 0 else after("x", k)) - F.col("x")) for k in (-2, -1, 1, 2)} | {f"y{k}": (before("y", -k) if k < 0 else after("y", k)) for k in (-2, -1, 1, 2)}
    p = points.select("stroke_id", "i", "y", *(v.alias(n.replace("-", "m")) for n, v in near.items())).where("um2 is not null and u2 is not null")
    sides = ("m2", "m1", "1", "2")
    power = lambda k: " + ".join("*".join([f"u{s}"] * k) for s in sides)
    with_y = lambda k: " + ".join("*".join([f"u{s}"] * k + [f"y{s}"]) for s in sides)
    sums = p.selectExpr("stroke_id", "i", *(f"{power(k)} as b{k}" for k in (1, 2, 3, 4)), "ym2 + ym1 + y + y1 + y2 as b0y", f"{with_y(1)} as b1y", f"{with_y(2)} as b2y")
    return sums.selectExpr(
        "stroke_id", "i", "5*b2*b4 - 5*b3*b3 - b1*b1*b4 + 2*b1*b2*b3 - b2*b2*b2 as den",
        "5*b2y*b2 - 5*b1y*b3 - b1*b2y*b1 + b1*b1y*b2 + b2*b0y*b3 - b2*b0y*b2 as num",
    ).selectExpr("stroke_id", "i", "case when abs(den) < 1e-10 then 0.0 else 2 * (num / den) end as c")


def inflections(curvature: DataFrame) -> DataFrame:
    """Rows (stroke_id, point, change, complexity, stability) where the curvature ``c`` at place ``k`` changes its sign."""
    smooth = {n: F.avg("c").over(frame(n // 2, n // 2)) for n in (1, 3, 5)}
    out = curvature.withColumns({f"s{n}": v for n, v in smooth.items()} | {"pc": before("c"), "nc": after("c"), "spread": F.stddev_pop("c").over(frame(5, 5))})
    out = out.withColumns({f"f{n}": (before(f"s{n}") * after(f"s{n}") < 0).cast("int") for n in smooth})
    hit = (F.col("pc") * F.col("nc") < 0) | ((F.abs("c") < 0.01) & (F.abs(F.col("pc") - F.col("nc")) > 0.1))
    return out.where(hit).select("stroke_id", (F.col("k") + 1).alias("point"), F.abs(F.col("nc") - F.col("pc")).alias("change"), F.col("spread").alias("complexity"), ((F.col("f1") + F.col("f3") + F.col("f5")) / 3.0).alias("stability"))


def inflection_pattern(found: DataFrame, strokes: DataFrame) -> DataFrame:
    """``stroke_id, n_inflections, pattern`` for every stroke in ``strokes``."""
    per = found.groupBy("stroke_id").agg(F.count("*").alias("n"), F.avg("change").alias("mean"), F.stddev_pop("change").alias("spread"))
    n = F.coalesce("n", F.lit(0))
    pattern = F.when(n == 0, "none").when(n == 1, "single").when(n == 2, "double").when(n <= 4, "multiple").when(F.col("spread") < 0.5 * F.col("mean"), "regular").otherwise("irregular")
    return strokes.select("stroke_id").distinct().join(per, "stroke_id", "left").select("stroke_id", n.cast("long").alias("n_inflections"), pattern.alias("pattern"))


def extrema(curvature: DataFrame) -> DataFrame:
    """Strict local maxima and minima of ``c`` over .01 in size: ``stroke_id, point, kind``."""
    out = curvature.withColumns({"pc": before("c"), "nc": after("c")})
    kind = F.when((F.col("c") > F.col("pc")) & (F.col("c") > F.col("nc")), "maximum").when((F.col("c") < F.col("pc")) & (F.col("c") < F.col("nc")), "minimum")
    return out.withColumn("kind", kind).where("kind is not null and abs(c) > 0.01").select("stroke_id", (F.col("k") + 1).alias("point"), "kind")


def curvature_entropy(curvature: DataFrame, bins: int = 20) -> DataFrame:
    """``stroke_id, entropy`` in bits of ``c`` over equal bins of [-max, max]; 0 if all are 0."""
    top = F.max(F.abs("c")).over(whole())
    binned = curvature.withColumn("top", top).where("top > 0").withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("c") + F.col("top")) / (2 * F.col("top") / bins))))
    counts = binned.groupBy("stroke_id", "bin").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(whole())
    found = counts.withColumn("h", -share * F.log2(share)).groupBy("stroke_id").agg(F.sum("h").alias("entropy"))
    return curvature.select("stroke_id").distinct().join(found, "stroke_id", "left").select("stroke_id", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def curvature_metrics(points: DataFrame) -> DataFrame:
    """The robust curvature's sums, spread, inflections and extrema of each stroke, scaled by its largest value."""
    c = robust_curvature(points)
    top = F.max(F.abs("c")).over(whole())
    scaled = c.withColumn("top", top).withColumn("c", F.when(F.col("top") > 0, F.col("c") / F.col("top")).otherwise(F.lit(0.0)))
    sums = scaled.groupBy("stroke_id").agg(F.sum(F.abs("c")).alias("total"), F.avg("c").alias("mean"), F.var_pop("c").alias("variance"), F.count("*").alias("n"))
    bends = inflections(scaled).groupBy("stroke_id").agg(F.count("*").alias("n_inflections"))
    tops = extrema(scaled).groupBy("stroke_id").agg(F.count("*").alias("n_extrema"))
    out = sums.join(bends, "stroke_id", "left").join(tops, "stroke_id", "left").na.fill(0, ["n_inflections", "n_extrema"])
    complexity = F.sqrt("variance") + 5 * F.col("n_inflections") / F.col("n") + 0.1 * F.col("n_extrema")
    return out.select("stroke_id", "total", "mean", "variance", "n_inflections", "n_extrema", complexity.alias("complexity"), (1 - F.least(F.lit(1.0), F.col("variance"))).alias("regularity"))


# -- affine -----------------------------------------------------------------------------------------------------------


def affine_arc(points: DataFrame) -> DataFrame:
    """``sigma``: affine arc length up to each point; the first two have 0."""
    steps = with_steps(points).withColumns({"pdx": before("dx"), "pdy": before("dy"), "pdt": before("dt")})
    mean_dt = (F.greatest("dt", F.lit(1.0)) + F.greatest("pdt", F.lit(1.0))) / 2
    det = (F.col("pdx") / mean_dt) * ((F.col("dy") - F.col("pdy")) / (mean_dt * mean_dt)) - ((F.col("dx") - F.col("pdx")) / (mean_dt * mean_dt)) * (F.col("pdy") / mean_dt)
    return steps.withColumn("sigma", F.sum(F.coalesce(F.pow(F.abs(det), F.lit(1 / 3)) * mean_dt, F.lit(0.0))).over(so_far()))


def affine_curvature(points: DataFrame) -> DataFrame:
    """``kappa`` of the points 2 to n-3; 0 where the affine length stands still.  Other points are left out."""
    p = affine_arc(points).withColumns({"n": F.count("*").over(whole()), "ps": before("sigma"), "ns": after("sigma"), "px": before("x"), "nx": after("x"), "py": before("y"), "ny": after("y")})
    p = p.where("i >= 2 and i < n - 2").withColumns({"d1": F.col("sigma") - F.col("ps"), "d2": F.col("ns") - F.col("sigma")})
    first = lambda c: (F.col(f"n{c}") - F.col(f"p{c}")) / (F.col("ns") - F.col("ps"))
    second = lambda c: ((F.col(f"n{c}") - F.col(c)) / F.col("d2") - (F.col(c) - F.col(f"p{c}")) / F.col("d1")) / ((F.col("d1") + F.col("d2")) / 2)
    still = (F.col("ns") - F.col("ps") < 1e-10) | (F.col("d1") < 1e-10) | (F.col("d2") < 1e-10)
    return p.withColumn("kappa", F.when(still, 0.0).otherwise(second("x") * first("y") - second("y") * first("x")))


def affine_metrics(points: DataFrame) -> DataFrame:
    """Totals, spread, complexity and mirror symmetry of the affine curvature of each stroke with five points or more."""
    k = affine_curvature(points).select("stroke_id", (F.col("i") - 2).alias("k"), "n", "kappa")
    other = k.select("stroke_id", (F.col("n") - 5 - F.col("k")).alias("k"), F.col("kappa").alias("mirror"))
    both = k.join(other, ["stroke_id", "k"], "left")
    half = F.floor((F.col("n") - 4) / 2)
    size = F.abs("kappa")
    out = both.groupBy("stroke_id").agg(F.max(size).alias("max_kappa"), F.avg(size).alias("mean_kappa"), F.var_pop(size).alias("var_kappa"), F.coalesce(F.avg(F.when(F.col("k") < half, F.exp(-10 * F.abs(F.col("kappa") - F.col("mirror"))))), F.lit(0.0)).alias("symmetry"))
    total = affine_arc(points).groupBy("stroke_id").agg(F.max("sigma").alias("affine_length"))
    return total.join(out, "stroke_id", "left").na.fill(0.0).withColumn("complexity", F.sqrt("var_kappa") / (F.col("mean_kappa") + 1e-10))


def affine_signature(points: DataFrame) -> DataFrame:
    """``stroke_id, i, sigma, kappa``: affine curvature over the affine arc length as a share of the whole, points 2 to n-3."""
    arc = affine_arc(points).withColumn("top", F.max("sigma").over(whole()))
    share = F.when(F.col("top") == 0, 0.0).otherwise(F.col("sigma") / F.nullif("top", F.lit(0.0)))
    # both sides are dealt by stroke already, so the join needs no shuffle of its own
    return affine_curvature(points).select("stroke_id", "i", "kappa").join(arc.select("stroke_id", "i", share.alias("sigma")), ["stroke_id", "i"])


def curvature_signature(points: DataFrame) -> DataFrame:
    """``stroke_id, i, s, kappa`` of the inner points: robust curvature times the path's length, over the share of it passed."""
    length = arc_length(points).withColumn("total", F.max("arc").over(whole()))
    rows = robust_curvature(points).select("stroke_id", "i", "c").join(length.select("stroke_id", "i", "arc", "total"), ["stroke_id", "i"])
    moved = F.col("total") > 0
    return rows.select("stroke_id", "i", F.when(moved, F.col("arc") / F.nullif("total", F.lit(0.0))).otherwise(0.0).alias("s"), F.when(moved, F.col("c") * F.col("total")).otherwise(F.col("c")).alias("kappa"))


def peaks_and_valleys(points: DataFrame) -> DataFrame:
    """``stroke_id, x_sequence, y_sequence``: P, V or - for each inner point that tops, undercuts or does neither to both
    neighbours."""
    sign = lambda c: F.when((F.col(c) > before(c)) & (F.col(c) > after(c)), "P").when((F.col(c) < before(c)) & (F.col(c) < after(c)), "V").otherwise("-")
    p = points.select("stroke_id", "i", sign("x").alias("sx"), sign("y").alias("sy"), before("x").isNotNull().alias("after_first"), after("x").isNotNull().alias("before_last"))
    inner = F.when(F.col("after_first") & F.col("before_last"), F.struct("i", "sx", "sy"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(inner)), lambda q: q[c]), "")
    return p.groupBy("stroke_id").agg(joined("sx").alias("x_sequence"), joined("sy").alias("y_sequence"))


def spline_controls(points: DataFrame, tension: float = 0.5) -> DataFrame:
    """Control points of the curve from each point 1 to n-3 to the next: ``stroke_id, i, c1x, c1y, c2x, c2y, x2, y2``."""
    p = points.withColumns({f"{c}{k}": v for c in "xy" for k, v in (("0", before(c)), ("2", after(c)), ("3", after(c, 2)))}).where("x0 is not null and x3 is not null")
    out = {f"c1{c}": F.col(c) + (F.col(f"{c}2") - F.col(f"{c}0")) * tension / 6 for c in "xy"} | {f"c2{c}": F.col(f"{c}2") - (F.col(f"{c}3") - F.col(c)) * tension / 6 for c in "xy"}
    return p.select("stroke_id", "i", *(v.alias(n) for n, v in out.items()), "x2", "y2")


def never_back(points: DataFrame, col: str = "time") -> DataFrame:
    """``col`` raised to the largest value so far, as after its jitter."""
    return points.withColumn(col, F.max(col).over(so_far()))


def processed(points: DataFrame) -> DataFrame:
    """Each point with the share of the path passed, the curvature times the path's length, velocity, acceleration and
    tangent; what a point does not have is 0, and strokes of one point have no rows."""
    p = turn_curvature(acceleration(points)).withColumns({"tangent": F.atan2("dy", "dx"), "arc": F.sum(F.coalesce("ds", F.lit(0.0))).over(so_far()), "total": F.sum(F.coalesce("ds", F.lit(0.0))).over(whole()), "n": F.count("*").over(whole())})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    moved, total = F.col("total") > 0, F.nullif("total", F.lit(0.0))
    return p.where("n > 1").select(
        "stroke_id", "i", "x", "y", "time", F.when(moved, F.col("arc") / total).otherwise(0.0).alias("s_L"), F.when(moved, zero(F.col("curvature") * F.col("total"))).otherwise(0.0).alias("kappa_L"),
        zero(F.col("velocity")).alias("velocity"), zero(F.col("acceleration")).alias("acceleration"), zero(F.col("tangent")).alias("tangent"),
    )
