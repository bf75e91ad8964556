"""Streams of points: sums that grow with a stroke, strokes cut at pauses, running counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def point_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def growing_strokes(points: DataFrame, late: str = "10 minutes", longest: str = "1 day") -> DataFrame:
    """Per stroke the running number, box and centre of its points (stroke_id, ts, x, y): all are sums that only grow.

    A stroke's sums are kept by the day of its points, so that the watermark can drop them; a stroke that goes on past midnight
    has a row for each day.
    """
    marked = points.withWatermark("ts", late)
    out = marked.groupBy(F.window("ts", longest), "stroke_id").agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    return out.withColumn("since", F.col("window.start")).drop("window")


def strokes_by_pause(points: DataFrame, pause: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A stroke ends when its writer pauses: session windows, closed by the watermark."""
    marked = points.withWatermark("ts", late)
    out = marked.groupBy("user_id", F.session_window("ts", pause)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Takes all that is there, batch by batch, into ``sink``, then stops; the checkpoint lets a later run go on."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
