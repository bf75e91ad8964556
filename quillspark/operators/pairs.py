"""Comparisons within a stroke: pairs of points and of segments.

A stroke's pairs are an equi-join on its id with the order of the two places as the residual; at scale both sides share one
hash partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.sequence import after, step, whole


def point_pairs(points: DataFrame) -> DataFrame:
    """``stroke_id, a, b, d`` for a < b."""
    p = points.select("stroke_id", "i", "x", "y")
    q = p.select("stroke_id", F.col("i").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    joined = p.join(q, "stroke_id").where("i < b")
    return joined.select("stroke_id", F.col("i").alias("a"), "b", step(F.col("xb") - F.col("x"), F.col("yb") - F.col("y")).alias("d"))


def rips_edges(points: DataFrame, eps: float) -> DataFrame:
    """Pairs at most ``eps`` apart, by cells of that width: only points of neighbouring cells meet."""
    cell = lambda c: F.floor(F.col(c) / eps)
    p = points.select("stroke_id", "i", "x", "y").withColumns({"cx": cell("x"), "cy": cell("y")})
    offsets = F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in (-1, 0, 1) for v in (-1, 0, 1)))
    q = p.select("stroke_id", F.col("i").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), "cx", "cy", F.explode(offsets).alias("o"))
    q = q.select("stroke_id", "b", "xb", "yb", (F.col("cx") + F.col("o.u")).alias("cx"), (F.col("cy") + F.col("o.v")).alias("cy"))
    d = step(F.col("xb") - F.col("x"), F.col("yb") - F.col("y"))
    return p.join(q, ["stroke_id", "cx", "cy"]).where("i < b").select("stroke_id", F.col("i").alias("a"), "b", d.alias("d")).where(F.col("d") <= eps)


def rips_triangles(edges: DataFrame) -> DataFrame:
    """Triples of mutually joined points, from the edges alone."""
    ab = edges.select("stroke_id", "a", "b")
    bc = edges.select("stroke_id", F.col("a").alias("b"), F.col("b").alias("c"))
    ac = edges.select("stroke_id", "a", F.col("b").alias("c"))
    return ab.join(bc, ["stroke_id", "b"]).join(ac, ["stroke_id", "a", "c"]).select("stroke_id", "a", "b", "c")


def segments(points: DataFrame) -> DataFrame:
    out = points.select("stroke_id", "i", "x", "y", after("x").alias("x2"), after("y").alias("y2"), F.count("*").over(whole()).alias("n"))
    return out.where("x2 is not null")


def segment_pairs(points: DataFrame) -> DataFrame:
    """Pairs of segments that do not touch in order, without that of the first and last: vectors ``v, u`` and ``r``."""
    s = segments(points)
    p = s.selectExpr("stroke_id", "i as s", "n", "x as px", "y as py", "x2 - x as vx", "y2 - y as vy")
    q = s.selectExpr("stroke_id", "i as t", "x as qx", "y as qy", "x2 as qx2", "y2 as qy2", "x2 - x as ux", "y2 - y as uy")
    return p.join(q, "stroke_id").where("t >= s + 2 and not (s = 0 and t = n - 2)")


def in_cells(found: DataFrame) -> DataFrame:
    """Each segment once for every cell it passes, ``cell`` (column, row): a stroke's box has about sqrt(n) / 4 cells a side, so
    that short segments of long strokes meet few others.  Cells reach a little over their borders; rounding loses no meeting."""
    slack, side = 1e-6, F.greatest(F.lit(1), F.floor(F.sqrt("n") / 4)).cast("int")
    ends = {}
    for axis in "xy":
        low, high = (f(F.least(axis, f"{axis}2") if f is F.min else F.greatest(axis, f"{axis}2")).over(whole()) for f in (F.min, F.max))
        for name in (axis, f"{axis}2"):
            ends[f"at_{name}"] = F.when(high > low, (F.col(name) - low) / (high - low) * side).otherwise(0.0)
    s = found.withColumns({**ends, "side": side})
    cell = lambda at: F.least(F.col("side") - 1, F.greatest(F.lit(0), F.floor(at).cast("int")))
    span = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - slack), cell(F.greatest(a, b) + slack)))
    s = s.withColumn("column", span(F.col("at_x"), F.col("at_x2")))
    run = F.nullif(F.col("at_x2") - F.col("at_x"), F.lit(0.0))
    enter, leave = ((F.col("column") + v - F.col("at_x")) / run for v in (-slack, 1 + slack))
    first, last = F.coalesce(F.greatest(F.lit(0.0), F.least(enter, leave)), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), F.greatest(enter, leave)), F.lit(1.0))
    height = lambda share: F.col("at_y") + share * (F.col("at_y2") - F.col("at_y"))
    s = s.withColumns({"from": F.when(run.isNull(), F.col("at_y")).otherwise(height(first)), "to": F.when(run.isNull(), F.col("at_y2")).otherwise(height(last))})
    s = s.withColumn("row", span(F.col("from"), F.col("to")))
    return s.select(*found.columns, F.struct("column", "row").alias("cell"))


def crossings(points: DataFrame) -> DataFrame:
    """Self-intersections: ``stroke_id, s, t, cx, cy, sign, angle``.  Only segments that pass a common cell are set side by side."""
    found = in_cells(segments(points))
    p = found.selectExpr("stroke_id", "cell", "i as s", "n", "x as px", "y as py", "x2 - x as vx", "y2 - y as vy")
    q = found.selectExpr("stroke_id", "cell", "i as t", "x as qx", "y as qy", "x2 - x as ux", "y2 - y as uy")
    p = p.join(q, ["stroke_id", "cell"]).where("t >= s + 2 and not (s = 0 and t = n - 2)")
    p = p.withColumn("den", F.expr("vx * uy - vy * ux")).where("abs(den) >= 1e-10")
    p = p.withColumns({"along": F.expr("((qx - px) * uy - (qy - py) * ux) / den"), "across": F.expr("((qx - px) * vy - (qy - py) * vx) / den")})
    p = p.where("along >= 0 and along <= 1 and across >= 0 and across <= 1").dropDuplicates(["stroke_id", "s", "t"])  # met in several cells
    cos = F.expr("(vx * ux + vy * uy)") / (step(F.col("vx"), F.col("vy")) * step(F.col("ux"), F.col("uy")))
    return p.select("stroke_id", "s", "t", F.expr("px + along * vx").alias("cx"), F.expr("py + along * vy").alias("cy"), F.when(F.col("den") > 0, 1).otherwise(-1).alias("sign"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))).alias("angle"))


def writhe(points: DataFrame) -> DataFrame:
    """Angles of the segments that lie on both sides of an earlier one's line, by 4 pi; 0 below four points."""
    p = segment_pairs(points).withColumns({"c1": F.expr("vx * (qy - py) - vy * (qx - px)"), "c2": F.expr("vx * (qy2 - py) - vy * (qx2 - px)")}).where("c1 * c2 < 0")
    cross, dot = F.expr("vx * uy - vy * ux"), F.expr("vx * ux + vy * uy")
    angle = F.when(cross > 0, F.atan2(cross, dot)).otherwise(-F.atan2(cross, dot))
    found = p.groupBy("stroke_id").agg((F.sum(angle) / (4 * math.pi)).alias("writhe"))
    return points.select("stroke_id").distinct().join(found, "stroke_id", "left").select("stroke_id", F.coalesce("writhe", F.lit(0.0)).alias("writhe"))


def loop_signature(points: DataFrame, eps: float = 0.1) -> DataFrame:
    """Lengths (b - a) / n, longest first, of the loops that close within ``eps``; none below four points."""
    n = points.groupBy("stroke_id").agg(F.count("*").alias("n"))
    loops = point_pairs(points).where((F.col("b") - F.col("a") > 2) & (F.col("d") < eps)).join(n, "stroke_id").where("n >= 4")
    found = loops.groupBy("stroke_id").agg(F.sort_array(F.collect_list((F.col("b") - F.col("a")) / F.col("n")), asc=False).alias("loops"))
    return n.join(found, "stroke_id", "left").select("stroke_id", F.coalesce("loops", F.array().cast("array<double>")).alias("loops"))


def from_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from the segment between a and b."""
    vx, vy, wx, wy = bx - ax, by - ay, x - ax, y - ay
    size = vx * vx + vy * vy
    share = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (wx * vx + wy * vy) / F.nullif(size, F.lit(0.0))))).otherwise(0.0)
    return step(wx - share * vx, wy - share * vy)


def near_segments(points: DataFrame, eps: float = 0.05) -> DataFrame:
    """Segments both of whose ends are less than ``eps`` from a later segment, two places on or more: ``stroke_id, s, t`` and
    the place ``idx`` in the middle."""
    c, found = F.col, segments(points)
    p = found.selectExpr("stroke_id", "i as s", "x as px", "y as py", "x2 as px2", "y2 as py2")
    q = found.selectExpr("stroke_id", "i as t", "x as qx", "y as qy", "x2 as qx2", "y2 as qy2")
    ends = [from_segment(c(x), c(y), c("qx"), c("qy"), c("qx2"), c("qy2")) < eps for x, y in (("px", "py"), ("px2", "py2"))]
    return p.join(q, "stroke_id").where("t >= s + 2").where(ends[0] & ends[1]).select("stroke_id", "s", "t", F.floor((c("s") + c("t")) / 2).alias("idx"))


def apart(rows: DataFrame, gap: int = 2) -> DataFrame:
    """Rows (stroke_id, idx, pos) of which no earlier one, kept or not, is less than ``gap`` places away."""
    first = rows.select("stroke_id", F.col("idx").alias("other"), F.col("pos").alias("first"))
    near = (F.abs(F.col("idx") - F.col("other")) < gap) & (F.col("first") < F.col("pos"))
    return rows.join(first, (rows["stroke_id"] == first["stroke_id"]) & near, "left_anti")
