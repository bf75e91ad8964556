"""Connected components of links that stay distributed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import materialize

HELD = 200_000


def _forest(links: dict[int, int]) -> pa.RecordBatch:
    nodes = [(x, r) for x in links if (r := _root(links, x)) != x]
    a, b = (np.array(x, np.int64) for x in (zip(*nodes) if nodes else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(b), pa.array(a)], names=["a", "b"])


def _root(parent: dict[int, int], x: int) -> int:
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = parent[up] if up in parent else up
        x = parent[x]
    return x


def forest_edges(pairs: DataFrame, links: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Edges (a, b) that join what ``links`` says of each batch: one per node and task, so stars, not all pairs, go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = links(batch)
            for a, b in zip(left.tolist(), right.tolist()):
                a, b = _root(parent, a), _root(parent, b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > HELD:
                yield _forest(parent)
                parent.clear()
        yield _forest(parent)

    return pairs.mapInArrow(run, "a long, b long")


def _same(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(), batch.column(1).to_numpy()


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every node of the edges (a, b): the least id reachable.

    Large-star and small-star steps alternate until no edge changes.  Each step is an aggregation to the least neighbour and
    a join of two written tables, which adaptive execution may split where a node has very many edges.
    """
    edges = materialize(forest_edges(edges, _same), "links").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "links-large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
