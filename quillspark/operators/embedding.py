"""Distances of vectors, their nearest neighbours, and the graph weights built on them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import blocks
from quillspark.state import written

#: Rows of a block when all are compared with all, at most.
BLOCK = 2048


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column, kind: str = "euclidean") -> Column:
    """Distance of two arrays of one length; an unequal length is an error."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors of different lengths"))
    if kind == "manhattan":
        value = _sum(F.zip_with(a, b, lambda p, q: F.abs(p - q)))
    elif kind == "cosine":
        dot = lambda u, v: _sum(F.zip_with(u, v, lambda p, q: p * q))
        size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        value = F.when(size > 0, 1 - dot(a, b) / size).otherwise(1.0)
    else:
        value = F.sqrt(_sum(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))
    return F.coalesce(same.cast("double"), value)


def neighbours(rows: DataFrame, queries: DataFrame, k: int, kind: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """``id, rank, other, d``: the k nearest of all other rows for each query, ties to the smaller id.

    Blocks of at most ``block`` queries meet all blocks of rows; a block of queries gives k rows for each of its queries and part
    of the rows, however many it compares, and those are merged by query.
    """
    (n, width), (asked, _) = (blocks.size_of(side, "v") for side in (rows, queries))
    cores, kind_of_id = blocks.cores(rows), dict(rows.dtypes)["id"]
    size = max(64, min(block, math.ceil(asked / (4 * cores))))
    rights = max(1, math.ceil(n * width / blocks.PART))
    lefts = max(1, min(math.ceil(asked / size), math.ceil(blocks.TASKS * cores / rights)))
    left = blocks.packed(queries, ["v"], size, "left")
    right = blocks.packed(rows, ["v"], max(256, blocks.BLOCK_BYTES // width), "right")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, found = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("left_name")[row].as_py() != name:
                    if found:
                        yield table(found, type_of_id)
                    name, ids, type_of_id = batch.column("left_name")[row].as_py(), blocks.ids_of(batch, row, "left"), batch.schema.field("left_ids").type.value_type
                    found = blocks.Nearest(ids, blocks.matrix(batch, row, "left_v", len(ids)), k, kind)
                ids = blocks.ids_of(batch, row, "right")
                found.add(ids, blocks.matrix(batch, row, "right_v", len(ids)))
        if found:
            yield table(found, type_of_id)

    def table(found: blocks.Nearest, type_of_id: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"id": pa.array(found.ids[found.row], type_of_id), "other": pa.array(found.other, type_of_id), "d": pa.array(found.d)})

    found = blocks.met(left, right, lefts, rights).mapInArrow(nearest, f"id {kind_of_id}, other {kind_of_id}, d double")
    order = Window.partitionBy("id").orderBy("d", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "other", "d", "rank")


def apart(x: np.ndarray, q: np.ndarray, kind: str) -> np.ndarray:
    """Distances of the rows of ``x`` from ``q``, each row on its own."""
    if kind == "manhattan":
        return np.abs(x - q).sum(axis=1)
    if kind == "cosine":
        size = np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum())
        return np.where(size > 0, 1 - (x * q).sum(axis=1) / np.where(size > 0, size, 1), 1.0)
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def stress(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``stress`` of places ``e`` against vectors ``v`` (id, v, e): root of the squared differences of all pairs' distances by the
    squares of those of the vectors.

    Blocks of at most ``block`` rows meet, each pair of them once, and give their two sums only.
    """
    n, width = blocks.size_of(rows, "v")
    cores = blocks.cores(rows)
    size = max(64, min(block, math.ceil(n / (4 * cores))))
    rights = max(1, math.ceil(n * width / blocks.PART))
    lefts = max(1, min(math.ceil(n / size), math.ceil(blocks.TASKS * cores / rights)))
    left = written(blocks.packed(rows, ["v", "e"], size, "left"), "stress-blocks")
    right = left.toDF(*(c.replace("left_", "right_", 1) for c in left.columns))
    # of the two orders of a pair of blocks one, so that all blocks come first in about as many pairs
    first, even = F.col("left_name") < F.col("right_name"), F.pmod(F.crc32("left_name") + F.crc32("right_name"), F.lit(2)) == 0
    both = blocks.met(left, right, lefts, rights).where((F.col("left_name") == F.col("right_name")) | ((F.col("left_name") != F.col("right_name")) & (first == even)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, other = (blocks.ids_of(batch, row, side) for side in ("left", "right"))
                v, e = ([blocks.matrix(batch, row, f"{side}_{c}", len(ids)) for side, ids in (("left", one), ("right", other))] for c in "ve")
                same = batch.column("left_name")[row].as_py() == batch.column("right_name")[row].as_py()
                total, wrong = blocks.differences(one, other, v, e, same)
                yield pa.RecordBatch.from_pydict({"total": [total], "wrong": [wrong]})

    found = both.mapInArrow(sums, "total double, wrong double")
    return found.agg(F.when(F.sum("total") > 0, F.sqrt(F.sum("wrong") / F.sum("total"))).otherwise(0.0).alias("stress"))


def fuzzy_weights(graph: DataFrame, k: int, steps: int = 64) -> DataFrame:
    """``weight`` of each edge (id, rank, other, d): exp(-(d - rho) / sigma), sigma by bisection to a total of log2 k."""
    lists = graph.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "d"))).alias("e"))
    lists = lists.withColumn("rho", F.array_min(F.transform("e", lambda x: x.d)))
    total = lambda sigma: _sum(F.transform("e", lambda x: F.exp(-F.greatest(x.d - F.col("rho"), F.lit(0.0)) / sigma)))
    goal = F.log2(F.lit(float(k)))

    def halve(s, _):
        mid = (s.low + s.high) / 2
        t = total(mid)
        return F.when(s.done | (F.abs(t - goal) < 1e-5), F.struct(s.low.alias("low"), s.high.alias("high"), F.lit(True).alias("done"))).when(t > goal, F.struct(s.low.alias("low"), mid.alias("high"), F.lit(False).alias("done"))).otherwise(F.struct(mid.alias("low"), s.high.alias("high"), F.lit(False).alias("done")))

    start = F.struct(F.lit(1e-10).alias("low"), F.lit(1000.0).alias("high"), F.lit(False).alias("done"))
    found = lists.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)).withColumn("sigma", (F.col("s.low") + F.col("s.high")) / 2)
    flat = found.select("id", "rho", "sigma", F.explode("e").alias("x"))
    return flat.select("id", "x.rank", "x.other", "x.d", F.exp(-F.greatest(F.col("x.d") - F.col("rho"), F.lit(0.0)) / F.col("sigma")).alias("weight"))


def overlap(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Mean share of neighbours that two graphs have in common (trustworthiness and continuity are both this).

    Each graph is worked out once."""
    side = lambda graph, one: graph.select("id", "other", F.lit(one).alias("one"))
    edges = side(first, True).unionByName(side(second, False)).groupBy("id", "other").agg(F.count_if("one").alias("a"), F.count_if(~F.col("one")).alias("b"))
    shares = edges.groupBy("id").agg(F.sum("a").alias("own"), (F.sum(F.col("a") * F.col("b")) / k).alias("share")).where("own > 0")
    return shares.agg(F.avg("share").alias("overlap"))


def symmetrised(graph: DataFrame) -> DataFrame:
    """The graph with every edge's reverse; where both are there, the weight met first in order of id and rank stays."""
    edge = lambda a, b, s: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), "weight", F.struct(F.col("id").alias("i"), F.col("rank").alias("r"), F.lit(s).alias("s")).alias("at"))
    # both ways from one row: the graph is worked out once
    both = graph.select(F.explode(F.array(edge("id", "other", 0), edge("other", "id", 1))).alias("e")).select("e.*")
    return both.groupBy("id", "other").agg(F.min_by("weight", "at").alias("weight"))
