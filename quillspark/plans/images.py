"""Queries that draw the strokes of the test tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import images as I
from quillspark.operators.pixels import rasterised
from quillspark.plans.registry import query, rounded
from quillspark.plans.strokes import box


def _images(spark, sf_dir, size=64):
    return I.drawn(rasterised(box(spark, sf_dir), size), size)


@query("img14_converted")
def _(spark, sf_dir):
    found = I.accepted(I.converted(_images(spark, sf_dir)), 0.3)
    return rounded(found.select("image_id", "status", "skeleton_points", "branches", "quality", F.size("strokes").alias("n_strokes")))


@query("img12_stroke_points")
def _(spark, sf_dir):
    return rounded(I.points_of(I.converted(_images(spark, sf_dir))))


@query("snk03_progress")
def _(spark, sf_dir):
    return rounded(I.progress(I.accepted(I.converted(_images(spark, sf_dir)), 0.3)))
