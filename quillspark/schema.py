"""Row types, and the views that read a driver table as strokes, catalog rows or predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.state import plain_unions

POINT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "time", "pressure")])
STROKE = T.StructType([T.StructField("id", T.StringType()), T.StructField("points", T.ArrayType(POINT)), T.StructField("completed", T.BooleanType()), T.StructField("color", T.StringType()), T.StructField("label", T.StringType())])
STATUSES = ("pending", "in_progress", "completed", "failed", "stopped")
MODEL_TYPES = ("cnn", "transformer", "hybrid", "ensemble")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_long(strokes: DataFrame, id_col: str = "id") -> DataFrame:
    """Nested strokes as rows (stroke_id, label, i, x, y, time, pressure)."""
    return strokes.select(F.col(id_col).alias("stroke_id"), "label", F.posexplode("points").alias("i", "p")).select("stroke_id", "label", "i", "p.x", "p.y", "p.time", "p.pressure")


def to_nested(points: DataFrame) -> DataFrame:
    """The inverse of ``to_long``."""
    parts = F.array_sort(F.collect_list(F.struct("i", "x", "y", "time", "pressure")))
    nested = points.groupBy("stroke_id").agg(F.first("label").alias("label"), parts.alias("p"))
    return nested.select("stroke_id", "label", F.transform("p", lambda q: F.struct(q.x.alias("x"), q.y.alias("y"), q.time.alias("time"), q.pressure.alias("pressure"))).alias("points"))


def embedding_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested strokes: consecutive pairs of an embedding's components are points, ten time units apart."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    point = lambda k: F.struct(
        F.get("embedding", 2 * k).cast("double").alias("x"), F.get("embedding", 2 * k + 1).cast("double").alias("y"), (F.lit(10.0) * k).alias("time"), F.lit(None).cast("double").alias("pressure")
    )
    points = F.transform(F.sequence(F.lit(0), half - 1), point)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stroke_id"), F.col("label").cast("string").alias("label"), points.alias("points"))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(embedding_strokes(spark, sf_dir), "stroke_id")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stroke per user: x in days, y the value, time in milliseconds, pressure from the properties."""
    from pyspark.sql import Window

    events = read(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("stroke_id"),
        F.col("event_type").alias("label"),
        (F.row_number().over(order) - 1).alias("i"),
        ((micros - 1704067200000000) / 1000000 / 86400).alias("x"),
        F.col("value").alias("y"),
        F.floor(micros / 1000).cast("double").alias("time"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("pressure"),
    )


def catalog_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.col("source").alias("source_type"), F.col("quality").cast("double").alias("quality_score"), (F.col("toxic") == 0).alias("is_validated"), F.col("n_chars").alias("n_points"))


def catalog_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("validation_accuracy"), (F.col("o_orderstatus") == "O").alias("is_active"), F.col("o_custkey").alias("owner"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of each embedding's first ten components against its label."""
    scores = F.transform(F.slice("embedding", 1, 10), lambda v: F.exp(v.cast("double")))
    total = F.aggregate("e", F.lit(0.0), lambda s, v: s + v)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", scores.alias("e"))
    probs = rows.select(F.col("vec_id").alias("id"), F.col("label").alias("target"), F.transform("e", lambda v: v / total).alias("p"))
    return probs.withColumn("predicted", (F.array_position("p", F.array_max("p")) - 1).cast("int"))
