"""Connected pieces of a stroke's points as the allowed distance grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.pairs import point_pairs


def merge_distances(points: DataFrame, steps: int = 20, most: float = 0.5) -> DataFrame:
    """``stroke_id, n, deaths``: distances at which pieces merge among the ``steps`` least pairs, ties of the last included.

    A fold over each stroke's few shortest pairs carries the points' piece numbers; no function leaves the JVM.
    """
    order = Window.partitionBy("stroke_id").orderBy("d")
    short = point_pairs(points).where(F.col("d") <= most).withColumn("rank", F.rank().over(order)).where(F.col("rank") <= steps)
    edges = short.groupBy("stroke_id").agg(F.array_sort(F.collect_list(F.struct("d", "a", "b"))).alias("edges"))
    strokes = points.groupBy("stroke_id").agg(F.count("*").alias("n")).join(edges, "stroke_id", "left")
    start = F.struct(F.sequence(F.lit(0), F.col("n").cast("int") - 1).alias("piece"), F.array().cast("array<double>").alias("deaths"))

    def join(state, edge):
        a, b = F.get(state.piece, edge.a), F.get(state.piece, edge.b)
        merged = F.struct(F.transform(state.piece, lambda p: F.when(p == b, a).otherwise(p)).alias("piece"), F.concat(state.deaths, F.array(edge.d)).alias("deaths"))
        return F.when(a == b, state).otherwise(merged)

    folded = F.aggregate(F.coalesce("edges", F.array().cast("array<struct<d:double,a:int,b:int>>")), start, join)
    return strokes.select("stroke_id", "n", folded["deaths"].alias("deaths"))


def betti_zero(merged: DataFrame, eps: float = 0.1) -> DataFrame:
    """Pieces at ``eps``, pieces that stay, and the summed persistence of those that merge."""
    gone = F.filter("deaths", lambda d: d > 1e-10)
    return merged.select(
        "stroke_id",
        (F.col("n") - F.size("deaths") + F.size(F.filter(gone, lambda d: d > eps))).cast("long").alias("b0"),
        (F.col("n") - F.size("deaths")).cast("long").alias("n_infinite"),
        F.aggregate(gone, F.lit(0.0), lambda s, d: s + d).alias("persistence"),
        F.aggregate(gone, F.lit(0.0), lambda s, d: s + F.log1p(d)).alias("complexity"),
    )


def betti_one(edges: DataFrame, strokes: DataFrame, triangles: DataFrame) -> DataFrame:
    """Euler characteristic of the complex: points less edges plus triangles."""
    count = lambda d, name: d.groupBy("stroke_id").agg(F.count("*").alias(name))
    return strokes.join(count(edges, "e"), "stroke_id", "left").join(count(triangles, "t"), "stroke_id", "left").select("stroke_id", (F.col("n") - F.coalesce("e", F.lit(0)) + F.coalesce("t", F.lit(0))).alias("euler"))


def persistence_summary(intervals: DataFrame) -> DataFrame:
    """Counts by dimension, mean and largest persistence of the finite intervals (stroke_id, dimension, persistence)."""
    finite = F.when(~F.col("is_infinite"), F.col("persistence"))
    return intervals.groupBy("stroke_id").agg(F.count_if(F.col("dimension") == 0).alias("n0"), F.count_if(F.col("dimension") == 1).alias("n1"), F.coalesce(F.avg(finite), F.lit(0.0)).alias("mean"), F.coalesce(F.max(finite), F.lit(0.0)).alias("largest"))


