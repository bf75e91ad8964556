"""Points of a stroke that stay put under small changes: detectors, their union, and what is counted of it.

All take the points of strokes within the unit square and give rows (stroke_id, idx, stability, type, category, block, one,
two); the last three put a stroke's rows in the order in which the detectors name them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import pairs
from quillspark.operators.extra import quarter_points
from quillspark.operators.sequence import after, before, turn_curvature

LINES = (0.25, 0.5, 0.75)


def _rows(df: DataFrame, idx: Column | str, stability: Column | float, kind: Column | str, category: str, block: int, one: Column | str, two: Column | int = 0) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    col = lambda v: v if isinstance(v, Column) else F.col(v)
    return df.select("stroke_id", col(idx).cast("long").alias("idx"), lit(stability).alias("stability"), lit(kind).alias("type"), F.lit(category).alias("category"), F.lit(block).alias("block"), col(one).cast("long").alias("one"), lit(two).cast("long").alias("two"))


def sharp_bends(points: DataFrame, least: float = 0.5, first_rate: float = 0.8) -> DataFrame:
    """Inner points of a curvature over ``least``, as stable as the curvature, at most 1."""
    bent = turn_curvature(points, signed=False).where(F.col("curvature") > least)
    kind = F.when(F.col("curvature") > first_rate, "primary").otherwise("secondary")
    return _rows(bent, "i", F.least("curvature", F.lit(1.0)), kind, "geometric", 0, "i")


def outermost(points: DataFrame) -> DataFrame:
    """First points of least x, greatest x, least y and greatest y, in that order: ``stroke_id, n, side, i``."""
    first = lambda key: F.min(F.struct(key, F.col("i")))["i"]
    ends = F.array(first(F.col("x")), first(-F.col("x")), first(F.col("y")), first(-F.col("y")))
    return points.groupBy("stroke_id").agg(F.count("*").alias("n"), ends.alias("ends")).select("stroke_id", "n", F.posexplode("ends").alias("side", "i"))


def double_jumps(points: DataFrame, least: float = 0.3) -> DataFrame:
    """Inner points whose curvature differs by more than ``least`` from that of both inner neighbours."""
    bent = turn_curvature(points, signed=False).withColumns({"was": before("curvature"), "next": after("curvature")})
    hit = bent.where((F.abs(F.col("curvature") - F.col("was")) > least) & (F.abs(F.col("next") - F.col("curvature")) > least))
    return _rows(hit, "i", 0.6, "tertiary", "geometric", 2, "i")


def geometric(points: DataFrame) -> DataFrame:
    corners = outermost(points).where("n >= 3")
    return sharp_bends(points).unionByName(_rows(corners, "i", 0.8, "secondary", "geometric", 1, "side")).unionByName(double_jumps(points))


def topological(points: DataFrame, eps: float = 0.05) -> DataFrame:
    """Both ends, and the middle places of segments that nearly lie on a later one."""
    last = points.groupBy("stroke_id").agg(F.max("i").alias("last")).where("last >= 1")
    ends = last.select("stroke_id", F.posexplode(F.array(F.lit(0), "last")).alias("side", "i"))
    close = pairs.near_segments(points, eps)
    return _rows(ends, "i", 0.95, "primary", "topological", 3, "side").unionByName(_rows(close, "idx", 0.7, "secondary", "topological", 4, "s", F.col("t")))


def statistical(points: DataFrame) -> DataFrame:
    found = quarter_points(points)
    return _rows(found, "i", F.col("stability"), F.when(F.col("q") == 2, "secondary").otherwise("tertiary"), "statistical", 5, "q")


def crossings_of_lines(points: DataFrame, lines: tuple[float, ...] = LINES) -> DataFrame:
    """Steps that meet a reference line, both ends included: ``stroke_id, i, axis, line, place`` (0 for y = line, 1 for x).

    ``place`` is the other coordinate where the line is met; not a number for a step along the line.
    """
    p = points.withColumns({"px": before("x"), "py": before("y")}).where("px is not null")
    at = F.explode(F.array(*(F.struct(F.lit(axis).alias("axis"), F.lit(k).alias("line"), F.lit(v).alias("value")) for axis in (0, 1) for k, v in enumerate(lines))))
    p = p.select("stroke_id", "i", "x", "y", "px", "py", at.alias("at"))
    side = lambda a, b: F.when(F.col("at.axis") == 0, F.col(a)).otherwise(F.col(b))
    was, now, value = side("py", "px"), side("y", "x"), F.col("at.value")
    other_was, other_now = side("px", "py"), side("x", "y")
    meets = ((was <= value) & (now >= value)) | ((was >= value) & (now <= value))
    share = F.when(now != was, (value - was) / F.nullif(now - was, F.lit(0.0))).otherwise(F.lit(float("nan")))
    return p.where(meets).select("stroke_id", "i", "at.axis", "at.line", (other_was + share * (other_now - other_was)).alias("place"))


def intersecting(points: DataFrame) -> DataFrame:
    return _rows(crossings_of_lines(points), "i", 0.5, "tertiary", "intersection", 6, "i", F.col("axis") * len(LINES) + F.col("line"))


def every(points: DataFrame) -> DataFrame:
    """All detectors' rows; ``points`` is read once for each, so it should be partitioned by stroke."""
    return geometric(points).unionByName(topological(points)).unionByName(statistical(points)).unionByName(intersecting(points))


def invariant_points(points: DataFrame, most: int = 20) -> DataFrame:
    """``stroke_id, place, idx, stability, type, category``: those of ``every`` that no earlier one of the stroke is near, and
    of them the ``most`` firmest, ties in the detectors' order."""
    order = Window.partitionBy("stroke_id").orderBy("block", "one", "two")
    rows = pairs.apart(every(points).withColumn("pos", F.row_number().over(order)))
    firm = Window.partitionBy("stroke_id").orderBy(F.col("stability").desc(), "pos")
    ranked = rows.withColumn("place", F.row_number().over(firm)).where(F.col("place") <= most)
    return ranked.select("stroke_id", "place", "idx", "stability", "type", "category")


def summary(found: DataFrame) -> DataFrame:
    """Invariant points by category, their share in per cent, and how many are of each type."""
    kinds = [F.count_if(F.col("type") == kind).alias(kind) for kind in ("primary", "secondary", "tertiary")]
    counts = found.groupBy("category").agg(F.count("*").alias("n"), *kinds)
    return counts.withColumn("percentage", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)  # four rows at most


def of_landmarks(landmarks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Landmarks (stroke_id, x, y, kind, stability) as invariants, whose index is the share x of the ``n`` points: a place on
    the page, not along the stroke."""
    return landmarks.join(sizes, "stroke_id").select("stroke_id", F.floor(F.col("x") * F.col("n")).alias("idx"), "stability", "kind")

