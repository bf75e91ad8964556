"""Checks of points and strokes, and their repair."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def point_errors(x: Column, y: Column, time: Column) -> Column:
    """Messages of the coordinates that are not finite numbers."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(finite(c), F.lit(False)), f"{n} is not a finite number") for n, c in (("x", x), ("y", y), ("time", time)))))


def check_strokes(points: DataFrame, most: int = 1000, bound: float = 10000.0) -> DataFrame:
    """``stroke_id, n_points, n_errors, n_warnings, is_valid`` by one window and one aggregation.

    Errors: broken points, fewer than two or more than ``most`` points, time that falls behind the last sound point.
    Warnings: equal times, far coordinates, negative times, pressure outside [0, 1].
    """
    w = Window.partitionBy("stroke_id").orderBy("i")
    sound = F.size(point_errors(F.col("x"), F.col("y"), F.col("time"))) == 0
    p = points.withColumn("sound", sound)
    p = p.withColumn("last", F.last(F.when(F.col("sound"), F.col("time")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    far = (F.abs("x") > bound) | (F.abs("y") > bound)
    broken, behind = ~F.col("sound"), F.col("sound") & (F.col("time") < F.col("last"))
    warned = [F.col("sound") & (F.col("time") == F.col("last")), F.col("sound") & far, F.col("sound") & (F.col("time") < 0), (F.col("pressure") < 0) | (F.col("pressure") > 1)]
    n = F.count("*")
    counted = p.groupBy("stroke_id").agg(n.alias("n_points"), (F.count_if(broken) + F.count_if(behind) + F.when((n < 2) | (n > most), 1).otherwise(0)).alias("n_errors"), sum((F.count_if(c) for c in warned), F.lit(0)).alias("n_warnings"))
    return counted.withColumn("is_valid", F.col("n_errors") == 0)


def imbalance(strokes: DataFrame) -> DataFrame:
    """``label, n, warning``: fewer than five rows, or under a third of the largest label's."""
    counts = strokes.groupBy("label").agg(F.count("*").alias("n"))
    top = F.max("n").over(Window.partitionBy())  # a row per label
    return counts.withColumn("warning", F.when(F.col("n") < 5, "few").when(F.col("n") * 3 < top, "imbalanced").otherwise("none"))


def repaired_times(times: Column) -> Column:
    """Times of an array made strictly rising: one that does not exceed the repaired one before it becomes that plus 1."""
    step = lambda acc, t: F.concat(acc, F.array(F.when(F.size(acc) == 0, t).when(t <= F.element_at(acc, -1), F.element_at(acc, -1) + 1).otherwise(t)))
    return F.aggregate(times, F.array().cast("array<double>"), step)


def normalised(points: DataFrame) -> DataFrame:
    """Pressure clamped, missing or broken coordinates 0."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    return points.withColumns({"x": zero("x"), "y": zero("y"), "pressure": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("pressure")))})


def report(found: DataFrame) -> DataFrame:
    return found.select("stroke_id", F.concat_ws("; ", F.concat(F.lit("points "), "n_points"), F.when(F.col("n_errors") > 0, F.concat(F.lit("errors "), "n_errors")), F.when(F.col("n_warnings") > 0, F.concat(F.lit("warnings "), "n_warnings"))).alias("report"))
