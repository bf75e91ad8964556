"""Projection of vectors onto the axes along which they vary most."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def projected(rows: DataFrame, features: str = "features", count: int = 2) -> tuple[DataFrame, DataFrame]:
    """``id, place`` of the rows on ``count`` axes, and ``axis, share`` of the variance that each explains.

    Sums of products of the components are taken over the partitions; what reaches the driver is one matrix of the vectors' width
    squared.  Of the two directions of an axis that one is taken in which its largest loading (the first of equal ones) is
    positive.  Rows without a vector, or with a component that is null or not finite, have no place; vectors of different lengths
    and more axes than components are errors; without rows both tables are empty.
    """
    spark = rows.sparkSession
    bad = F.exists(features, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    use = rows.where(F.col(features).isNotNull() & ~F.coalesce(bad, F.lit(False))).select("id", F.transform(features, lambda v: v.cast("double")).alias("v"))
    sizes = use.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("width")).first()
    if not sizes["n"]:
        return use.select("id", F.col("v").alias("place")), spark.createDataFrame([], "axis int, share double")
    if sizes["low"] != sizes["width"]:
        raise ValueError("vectors of different lengths")
    if count > sizes["width"]:
        raise ValueError("more axes than components")
    vectors = use.select("id", array_to_vector("v").alias("v"))
    model = PCA(k=count, inputCol="v", outputCol="at").fit(vectors)
    mean = vectors.select(Summarizer.mean(F.col("v")).alias("mean")).first()["mean"].toArray()
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(count)])
    start = mean @ loadings
    at = vector_to_array("at")
    place = F.array(*((F.get(at, F.lit(k)) - float(start[k])) * float(signs[k]) for k in range(count)))
    shares = [(k, float(v)) for k, v in enumerate(model.explainedVariance.toArray())]
    return model.transform(vectors).select("id", place.alias("place")), spark.createDataFrame(shares, "axis int, share double")
