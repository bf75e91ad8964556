"""Loops of a stroke's points as the allowed distance grows, Betti numbers, and the features of both dimensions.

Loops are found as the blueprint finds them: at each of the shortest distances, every point not yet visited starts a walk in
depth over the points within that distance, and the walk that meets a visited point other than the one it came from makes an
interval and stops, leaving the rest unvisited.  The outcome depends on the order of the walk, so it is a procedure: a function
on Arrow groups, one for each stroke.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import pairs, topology
from quillspark.state import dealt

STEPS, MOST = 20, 0.5
#: Intervals shorter than this are dropped.
LEAST = 1e-10


def walk_meets(start: int, near: list[list[int]], visited: list[bool], came_from: list[int]) -> bool:
    """Whether the walk from ``start`` meets a visited point that it did not come from; a stack in place of recursion."""
    visited[start] = True
    path = [(start, iter(near[start]))]
    while path:
        at, rest = path[-1]
        for other in rest:
            if not visited[other]:
                visited[other], came_from[other] = True, at
                path.append((other, iter(near[other])))
                break
            if came_from[at] != other:
                return True
        else:
            path.pop()
    return False


def loops(x: np.ndarray, y: np.ndarray, steps: int = STEPS, most: float = MOST) -> list[tuple[float, float]]:
    """(birth, death) of each loop; those born at the last distance never live and are left out."""
    n = len(x)
    if n < 3:
        return []
    apart = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    upper = apart[np.triu_indices(n, 1)]
    values = np.sort(upper[upper <= most])[:steps]
    found = []
    for k, eps in enumerate(values[:-1]):
        if values[k + 1] - eps <= LEAST:
            continue
        close = apart <= eps
        np.fill_diagonal(close, False)
        near = [np.flatnonzero(row).tolist() for row in close]
        visited, came_from = [False] * n, [-1] * n
        for point in range(n):
            if not visited[point] and walk_meets(point, near, visited, came_from):
                found.append((float(eps), float(values[k + 1])))
    return found


def loop_intervals(points: DataFrame, steps: int = STEPS, most: float = MOST) -> DataFrame:
    """``stroke_id, birth, death`` of the loops."""
    kind = dict(points.dtypes)["stroke_id"]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        found = loops(rows.column("x").to_numpy(), rows.column("y").to_numpy(), steps, most)
        births, deaths = zip(*found) if found else ((), ())
        ids = rows.column("stroke_id").combine_chunks().take(pa.array([0] * len(found), pa.int64()))
        return pa.table({"stroke_id": ids, "birth": pa.array(births, pa.float64()), "death": pa.array(deaths, pa.float64())})

    return dealt(points.select("stroke_id", "i", "x", "y"), "stroke_id").groupBy("stroke_id").applyInArrow(run, f"stroke_id {kind}, birth double, death double")


def intervals(points: DataFrame, steps: int = STEPS, most: float = MOST) -> DataFrame:
    """All intervals: ``stroke_id, dimension, birth, death, persistence, is_infinite``; a piece that stays has no death."""
    merged = topology.merge_distances(points, steps, most)
    dead = merged.select("stroke_id", F.explode("deaths").alias("death")).where(F.col("death") > LEAST)
    stay = merged.select("stroke_id", F.explode(F.array_repeat(F.lit(None).cast("double"), (F.col("n") - F.size("deaths")).cast("int"))).alias("death"))
    pieces = dead.unionByName(stay).select("stroke_id", F.lit(0).alias("dimension"), F.lit(0.0).alias("birth"), "death")
    both = pieces.unionByName(loop_intervals(points, steps, most).select("stroke_id", F.lit(1).alias("dimension"), "birth", "death"))
    return both.withColumns({"persistence": F.col("death") - F.col("birth"), "is_infinite": F.col("death").isNull()})


def betti_numbers(found: DataFrame, eps: float = 0.1) -> DataFrame:
    """``stroke_id, b0, b1, b2`` at ``eps``; points in the plane enclose no voids."""
    alive = (F.col("birth") <= eps) & (F.col("is_infinite") | (F.col("death") > eps))
    count = lambda d: F.count_if(alive & (F.col("dimension") == d))
    return found.groupBy("stroke_id").agg(*(count(d).alias(f"b{d}") for d in (0, 1)), F.lit(0).cast("long").alias("b2"))


def metrics(points: DataFrame, eps: float = 0.1) -> DataFrame:
    """Betti numbers, persistence and its spread over the finite intervals of both dimensions, Euler number and loop lengths.

    ``points`` lie in the unit square.
    """
    found = intervals(points)
    lived = F.when(~F.col("is_infinite"), F.col("persistence"))
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    sums = found.groupBy("stroke_id").agg(
        zero(F.sum(lived)).alias("total"), zero(F.max(lived)).alias("largest"), zero(F.sum(F.log1p(lived))).alias("complexity"),
        zero(F.avg(lived)).alias("mean"), zero(F.stddev_pop(lived)).alias("spread"), F.count(lived).alias("n_finite"),
    )
    out = betti_numbers(found, eps).join(sums, "stroke_id").join(pairs.loop_signature(points, eps), "stroke_id")
    return out.withColumn("euler", F.col("b0") - F.col("b1") + F.col("b2"))


def features(found: DataFrame) -> DataFrame:
    """15 numbers of each stroke's ``metrics``."""
    head = [F.col(c).cast("double") for c in ("b0", "b1", "b2", "total", "largest", "complexity", "euler")]
    tail = [F.col(c).cast("double") for c in ("mean", "spread", "n_finite")]
    five = F.slice(F.concat("loops", F.array_repeat(F.lit(0.0), 5)), 1, 5)
    return found.select("stroke_id", F.concat(F.array(*head), five, F.array(*tail)).alias("features"))
