"""Approximate nearest neighbours by hierarchical navigable small worlds, one graph per shard.

Equal vectors are indexed once, with the least ids that have them.  The distinct vectors are dealt by hash into shards of
about ``SHARD``; a task builds each shard's graph and writes it as flat arrays: for every layer a table of neighbours with a
fixed number of places.  Queries, in blocks, visit every shard; the shards' results are merged by exact score.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.pivot_join import _matrix, usable
from quillspark.llm.shared import bound_batches, materialize

SHARD, QUERY_BLOCK = 4000, 1024
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 12, 64, 160
SALTS = 32


class Graph:
    """Unit vectors ``x`` with neighbour tables ``layers`` (layer, node, place), -1 where a place is free."""

    def __init__(self, x: np.ndarray, layers: np.ndarray, entry: int):
        self.x, self.layers, self.entry = x, layers, entry
        self.seen, self.mark = np.zeros(len(x), np.int64), 0

    def climb(self, q: np.ndarray, at: int, layer: int) -> int:
        """The node that no neighbour in the layer betters."""
        best = float(self.x[at] @ q)
        while True:
            near = self.layers[layer, at]
            near = near[near >= 0]
            if not len(near):
                return at
            scores = self.x[near] @ q
            k = int(scores.argmax())
            if scores[k] <= best:
                return at
            best, at = float(scores[k]), int(near[k])

    def widen(self, q: np.ndarray, at: int, layer: int, width: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes that a best-first walk finds, as (score, node)."""
        self.mark += 1
        self.seen[at] = self.mark
        score = float(self.x[at] @ q)
        ahead, best = [(-score, at)], [(score, at)]
        while ahead:
            least, node = heapq.heappop(ahead)
            if len(best) >= width and -least < best[0][0]:
                break
            near = self.layers[layer, node]
            near = near[near >= 0]
            near = near[self.seen[near] != self.mark]
            if not len(near):
                continue
            self.seen[near] = self.mark
            scores = self.x[near] @ q
            if len(best) >= width:
                keep = scores > best[0][0]
                near, scores = near[keep], scores[keep]
            for s, n in zip(scores.tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (s, n))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, n))
                else:
                    continue
                heapq.heappush(ahead, (-s, n))
        return best

    def search(self, q: np.ndarray, width: int) -> list[int]:
        at = self.entry
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self.climb(q, at, layer)
        return [n for _, n in self.widen(q, at, 0, width)]


def diverse(x: np.ndarray, q: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the nodes, nearest first, each nearer to q than to those chosen; then the nearest of the rest."""
    scores = x[nodes] @ q
    order = np.argsort(-scores, kind="stable")
    nodes, scores = nodes[order], scores[order]
    if len(nodes) <= most:
        return nodes
    mutual = x[nodes] @ x[nodes].T
    barred, chosen = np.full(len(nodes), -np.inf), []
    for k in range(len(nodes)):
        if barred[k] < scores[k]:
            chosen.append(k)
            if len(chosen) == most:
                break
            np.maximum(barred, mutual[k], out=barred)
    if len(chosen) < most:
        rest = np.setdiff1d(np.arange(len(nodes)), chosen)
        chosen += rest[: most - len(chosen)].tolist()
    return nodes[chosen]


def build(x: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 1) -> Graph:
    n, places = len(x), 3 * links
    levels = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / math.log(links)).astype(int), 6)
    levels[0] = levels.max(initial=0)
    graph = Graph(x, np.full((int(levels.max(initial=0)) + 1, n, places), -1, np.int32), 0)
    degree = np.zeros(graph.layers.shape[:2], np.int32)
    for node in range(1, n):
        at = graph.entry
        for layer in range(len(graph.layers) - 1, levels[node], -1):
            at = graph.climb(x[node], at, layer)
        for layer in range(levels[node], -1, -1):
            found = graph.widen(x[node], at, layer, width)
            at = max(found)[1]
            near = diverse(x, x[node], np.array([k for _, k in found]), links)
            table, full = graph.layers[layer], degree[layer]
            table[node, : len(near)], full[node] = near, len(near)
            for other in near.tolist():
                if full[other] == places:  # keep the best two thirds
                    kept = diverse(x, x[other], table[other], 2 * links)
                    table[other] = -1
                    table[other, : len(kept)], full[other] = kept, len(kept)
                table[other, full[other]] = node
                full[other] += 1
    return graph


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def least_ids(keyed: DataFrame, count: int) -> DataFrame:
    """Each class's vector and its ``count`` least ids; first within salted parts, so that no class meets whole in a task."""
    part = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    first = part.withColumn("place", F.row_number().over(Window.partitionBy("class_key", "salt").orderBy("id"))).where(F.col("place") <= count)
    return first.groupBy("class_key").agg(F.first("space").alias("space"), F.first("v").alias("v"), F.slice(F.array_sort(F.collect_list("id")), 1, count).alias("ids"))


def index(classes: DataFrame, shard: int = SHARD) -> DataFrame:
    """``space, shard, n, dims, entry, layers, vectors, neighbours, ids``: a row of flat arrays for each shard."""
    sizes = classes.groupBy("space").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = classes.join(materialize(sizes, "graph-sizes"), "space").withColumn("shard", F.pmod(F.xxhash64("class_key"), F.col("shards")).cast("int"))

    def make(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("class_key")
        x = unit(_matrix(rows.column("v")))
        graph = build(x.astype(np.float32))
        return pa.table(
            {
                "space": rows.column("space").slice(0, 1),
                "shard": rows.column("shard").slice(0, 1),
                "dims": pa.array([x.shape[1]], pa.int32()),
                "layers": pa.array([len(graph.layers)], pa.int32()),
                "entry": pa.array([graph.entry], pa.int32()),
                "vectors": pa.array([x.tobytes()], pa.binary()),
                "neighbours": pa.array([graph.layers.tobytes()], pa.binary()),
                "ids": pa.array([rows.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            }
        )

    return dealt.select("space", "shard", "class_key", "v", "ids").groupBy("space", "shard").applyInArrow(make, "space string, shard int, dims int, layers int, entry int, vectors binary, neighbours binary, ids array<array<bigint>>")


def search(graphs: DataFrame, queries: DataFrame, nearest: int, width: int) -> DataFrame:
    """``query_id, vec_id, score`` from every shard: its ``nearest`` best for each query (query_id, space, v)."""
    shards = materialize(graphs.select("space", "shard"), "graph-shards")
    blocks = queries.groupBy("space").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    blocks = materialize(blocks, "graph-blocks")
    asked = queries.join(blocks, "space").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).join(shards, "space").select("space", "shard", "block", "query_id", "v")
    copies = graphs.join(blocks, "space").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            x = np.frombuffer(row["vectors"]).reshape(-1, row["dims"])
            graph = Graph(x.astype(np.float32), np.frombuffer(row["neighbours"], np.int32).reshape(row["layers"], len(x), -1), row["entry"])
            exact = unit(_matrix(right.column("v")))
            for query_id, q in zip(right.column("query_id").to_pylist(), exact):
                found = np.array(graph.search(q.astype(np.float32), max(width, nearest + 1)))
                scores = (x[found] * q).sum(axis=1)  # row by row, so that equal vectors score alike
                best = sorted((-s, v) for s, k in zip(scores.tolist(), found.tolist()) for v in row["ids"][k] if v != query_id)
                out += [(query_id, v, -s) for s, v in best[:nearest]]
        columns = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return copies.groupBy("space", "shard", "block").cogroup(asked.groupBy("space", "shard", "block")).applyInArrow(ask, "query_id long, vec_id long, score double")


def nearest_vectors(vectors: DataFrame, every: int = 50, nearest: int = 5, width: int = SEARCH_WIDTH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for each row whose id is divisible by ``every``.

    Nearness is the cosine, in double precision on the vectors as given; ties go to the smaller id.  Vectors that are null,
    zero or hold null or non-finite components, and rows with a null id, take no part.  Vectors of different lengths are
    not compared.  Rows repeating an id count once.  With fewer candidates all are returned; an empty table gives no rows.
    """
    bound_batches(vectors.sparkSession)
    rows = usable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw")).where("id is not null"), "raw")
    rows = rows.select("id", F.size("v").cast("string").alias("space"), "v").dropDuplicates(["id"])
    keyed = materialize(rows.withColumn("class_key", F.sha1(F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ","))), "graph-rows")
    classes = materialize(least_ids(keyed, nearest + 1), "graph-classes")
    graphs = materialize(index(classes), "graphs")
    queries = keyed.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "space", "v")
    found = materialize(search(graphs, queries, nearest, width), "graph-found")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
