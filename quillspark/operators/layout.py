"""Iterative layout of a weighted neighbour graph.

Places are a table by node, which all tasks get where it is small.  In each epoch every edge sends the place of its far end to its near one, and every node asks for the
places of ``NEGATIVES`` nodes that a digest draws; messages meet their node's own place and are added up.  All forces of an epoch
come from the places before it.  Parts of a force are whole numbers, of 2^-20 and of 2^-60, so sums do not depend on their order and
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.training import draw
from quillspark.state import dealt, written

EPOCHS, SPREAD, RATE, NEGATIVES, SLOWING = 200, 1.0, 1.0, 5, 0.99
COARSE, FINE = 2.0**20, 2.0**40
#: Up to so many nodes their places, some 70 bytes each, are sent to all tasks in each epoch; more are joined by shuffles.
SENT = 500_000


def rate_of(epoch: Column, epochs: int, rate: float = RATE) -> Column:
    """The rate shrinks after each epoch past the first half, from the next one on."""
    return rate * F.pow(F.lit(SLOWING), F.greatest(F.lit(0), epoch - (epochs // 2 + 1)))


def negative(seed: int, n: int) -> Column:
    return F.floor(draw(F.lit(seed), F.col("epoch"), F.col("number"), F.col("k")) * n).cast("long")


def step(edges: DataFrame, places: DataFrame, n: int, epochs: int, rate: float, spread: float, seed: int) -> DataFrame:
    """``places`` (id, number, place, epoch) one epoch later.  The epoch is a column, so that all epochs have one plan and its code
    is compiled once."""
    axes = range(3)
    sent = F.broadcast if n <= SENT else lambda table: table
    pulls = edges.join(sent(places), "id").select("id", "number", "place", "epoch", "far", "weight")
    # a node that draws itself is pushed nowhere, and so has a message at least
    pushes = places.select("id", "number", "place", "epoch", F.explode(F.sequence(F.lit(0), F.lit(NEGATIVES - 1))).alias("k"))
    pushes = pushes.select("id", "number", "place", "epoch", negative(seed, n).alias("far"), F.lit(None).cast("double").alias("weight"))
    met = pulls.unionByName(pushes).join(sent(places.select(F.col("number").alias("far"), F.col("place").alias("there"))), "far")
    gap = [F.get("there", F.lit(a)) - F.get("place", F.lit(a)) for a in axes]
    away = F.sqrt(sum((g * g for g in gap), F.lit(0.0)))
    now = rate_of(F.col("epoch"), epochs, rate)
    pull = F.col("weight") * F.greatest(F.lit(0.0), 1 - away / spread) * now
    push = -1 / (1 + away * away / spread) * now * 0.5
    met = met.withColumn("force", F.when(F.col("weight").isNotNull(), pull).otherwise(push))
    parts = met.select("id", "number", "place", "epoch", *((F.col("force") * g * COARSE).alias(f"f{a}") for a, g in enumerate(gap)))
    whole = [F.sum(F.floor(f"f{a}")) for a in axes]
    rest = [F.sum(F.floor((F.col(f"f{a}") - F.floor(f"f{a}")) * FINE)) for a in axes]
    sums = parts.groupBy("id").agg(F.any_value("number").alias("number"), F.any_value("place").alias("place"), F.any_value("epoch").alias("epoch"), *(((w + r / FINE) / COARSE).alias(f"f{a}") for a, w, r in zip(axes, whole, rest)))
    return sums.select("id", "number", F.array(*(F.get("place", F.lit(a)) + F.col(f"f{a}") for a in axes)).alias("place"), (F.col("epoch") + 1).alias("epoch"))


def laid_out(graph: DataFrame, places: DataFrame, epochs: int = EPOCHS, spread: float = SPREAD, rate: float = RATE, seed: int = 42) -> DataFrame:
    """``id, number, place`` after all epochs.

    ``graph`` has the edges (id, other, weight) of both directions; ``places`` the nodes (id, number, place), numbered from 0
    without gaps, each place three numbers.  Edges to ids without a place
    pull nowhere; without nodes there are no rows.
    """
    state = written(places.select("id", "number", "place", F.lit(0).alias("epoch")), "layout-places")
    numbers = state.select(F.col("id").alias("other"), F.col("number").alias("far"))
    # a node's edges in one file, so that where places are sent its forces are added up before they are shuffled
    edges = written(dealt(graph.join(numbers, "other").select("id", "far", "weight"), "id"), "layout-edges")
    n = state.count()
    for _ in range(epochs if n else 0):
        # written each time: it is small beside the messages, and its size tells the next epoch's joins what they deal with
        state = written(step(edges, state, n, epochs, rate, spread, seed), "layout-places")
    return state.drop("epoch")
