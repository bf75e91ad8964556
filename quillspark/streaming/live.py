"""Strokes analysed anew as they grow.

State by stroke keeps its points in order of time; a micro-batch puts out all points so far of the strokes that it touches, and
these are analysed as a batch is.  Results are a folder for each micro-batch, so a batch that is done again overwrites its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators import analysis

#: Points beyond which a growing stroke is analysed.
LEAST = 10
COLUMNS = ("x", "y", "time", "pressure")


def prefixes(points: DataFrame, least: int = LEAST, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """``stroke_id, label, i, x, y, time, pressure`` of all points so far, for strokes that a batch of ``points`` (stroke_id, label, x,
    y, time, pressure, ts) touches and that have more than ``least``.

    Points go by time, those of one time in the order of arrival; a point that comes late within the watermark takes its place,
    later ones are dropped with the watermark.  A point equal to one there in all its values is told once.  A stroke's first
    label stays.  A stroke leaves memory ``idle_ms`` after its newest point.
    """
    kind = dict(points.dtypes)["stroke_id"]

    def grow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        label, rows, newest = (None, [], 0)
        if state.exists:
            label, newest, *held = state.get
            rows = list(zip(*held))
        for frame in frames:
            label = frame["label"].iloc[0] if label is None else label
            newest = max(newest, int(frame["ts"].max().timestamp() * 1000))
            rows += [tuple(None if pd.isna(v) else float(v) for v in r) for r in frame[list(COLUMNS)].itertuples(index=False)]
        rows = sorted(dict.fromkeys(rows), key=lambda r: (r[2] is not None, r[2] or 0.0))
        state.update((label, newest, *(list(c) for c in zip(*rows))))
        state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))
        if len(rows) > least:
            yield pd.DataFrame({"stroke_id": key[0], "label": label, "i": range(len(rows)), **dict(zip(COLUMNS, zip(*rows)))})

    lists = ", ".join(f"{c} array<double>" for c in COLUMNS)
    rows = points.select("stroke_id", F.col("label").cast("string").alias("label"), *COLUMNS, "ts").withWatermark("ts", late)
    return rows.groupBy("stroke_id").applyInPandasWithState(
        grow, f"stroke_id {kind}, label string, i int, x double, y double, time double, pressure double", f"label string, newest long, {lists}", "append", GroupStateTimeout.EventTimeTimeout
    )


def analysis_sink(spark: SparkSession, folder: str, parts: tuple[str, ...] = analysis.PARTS) -> Callable[[DataFrame, int], None]:
    """A batch function that writes a batch's points and their analysis under its number.

    The analysis reads the written points in ``spark``, a session of batches: a stream's own session plans without adaptive
    execution and by the partitions of its state.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/points/batch={number}")
        points = spark.read.schema(batch.schema).parquet(f"{folder}/points/batch={number}")
        analysis.analyse(points, parts).write.mode("overwrite").parquet(f"{folder}/analysed/batch={number}")

    return take


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest analysis of each stroke."""
    rows = spark.read.option("basePath", f"{folder}/analysed").parquet(f"{folder}/analysed")
    fields = [c for c in rows.columns if c != "batch"]
    newest = rows.groupBy("stroke_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["stroke_id", "batch"]).select(*fields)
