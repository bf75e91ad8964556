"""Imports of image files that end in tables, each file once.

A stream reads the files; a micro-batch is converted and written under the import's name and the batch's number, so a batch that is
done again after a failure overwrites what it had written.  All counts are read from these tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import images, records
from quillspark.sources.files import DECODED, EXTENSIONS, decoded_images, extension, label_of_path
from quillspark.streaming.progress import told_once
from quillspark.streaming.strokes import run_available

FILE = "path string, modificationTime timestamp, length long, content binary"
FILES = "image_id string, label string, status string, error string, n_strokes int, quality double, import_id string, batch int"
STROKES = "id string, label string, points array<struct<x: double, y: double, time: double, pressure: double>>, quality_score double, source_type string, import_id string, batch int"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def import_files(
    spark: SparkSession, source: str, target: str, import_id: str, labels: list[str] | None = None, least: float = 0.0, source_type: str = "upload", per_batch: int = 1000, sink: Callable[[int, int], None] | None = None
) -> DataFrame:
    """Imports what is under ``source`` and was not imported under this name before; the import's row of ``imports_of``.

    Files of other kinds than images fail with a message and stop nothing, as do those that cannot be read or are below the
    least quality; with ``labels``, files of other labels are left out.  ``sink`` is told the totals each ten files.  A source
    that does not exist is an error.
    """
    if not exists(spark, source):
        raise ValueError(f"Source path does not exist: {source}")
    if not exists(spark, target):
        place = spark._jvm.org.apache.hadoop.fs.Path(target)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    stream = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(source)
    tell = told_once(f"{target}/progress/import_id={import_id}", sink) if sink else None

    def take(batch: DataFrame, number: int) -> None:
        files = records.of_labels(batch.withColumn("label", label_of_path(F.col("path"))), labels or [])
        fits = extension(F.col("path")).isin(*EXTENSIONS)
        own = F.regexp_replace("path", "^file:/+", "file:/").alias("image_id")
        drawn = extension(F.col("path")).isin(*DECODED)
        found = images.converted(files.where(fits & ~drawn).select(own, "content"))
        paths = [row["image_id"] for row in files.where(fits & drawn).select(own).collect()]  # at most ``per_batch``
        if paths:
            found = found.unionByName(images.converted(decoded_images(spark, [re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for path in paths])))  # names, not patterns
        done = images.accepted(found, least)
        done = files.where(fits).select(own, "label").join(done, "image_id")
        name = F.element_at(F.split("path", "/"), -1)
        other = files.where(~fits).select(F.col("path").alias("image_id"), "label", F.lit("failed").alias("status"), F.concat(F.lit("Unsupported file type: "), name).alias("error"))
        both = done.unionByName(other, allowMissingColumns=True)
        where = f"import_id={import_id}/batch={number}"
        both.write.mode("overwrite").parquet(f"{target}/converted/{where}")
        held = spark.read.schema(both.schema).parquet(f"{target}/converted/{where}")
        good = held.where("status = 'processed'").select("image_id", "label", "quality", F.posexplode("strokes").alias("k", "points"))
        strokes = good.select(F.concat("image_id", F.lit("#"), F.col("k").cast("string")).alias("id"), "label", "points", F.col("quality").alias("quality_score"), F.lit(source_type).alias("source_type"))
        strokes.write.mode("overwrite").parquet(f"{target}/strokes/{where}")
        # last, as what is listed here counts as imported
        rows = held.select("image_id", "label", "status", "error", F.coalesce(F.size("strokes"), F.lit(0)).alias("n_strokes"), "quality")
        rows.write.mode("overwrite").parquet(f"{target}/files/{where}")
        if tell:
            tell(rows.select("status"), number)

    run_available(stream, take, f"{target}/checkpoints/{import_id}")
    return imports_of(spark, target).where(F.col("import_id") == import_id)


def imported(spark: SparkSession, target: str, table: str) -> DataFrame:
    """``files`` or ``strokes`` of all imports under ``target``; no rows before the first."""
    schema = FILES if table == "files" else STROKES
    if not exists(spark, f"{target}/{table}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{target}/{table}").parquet(f"{target}/{table}")


def imports_of(spark: SparkSession, target: str) -> DataFrame:
    """A row for each import: totals, share of success in per cent, strokes made, from the listed files."""
    good = F.count_if(F.col("status") == "processed")
    rows = imported(spark, target, "files").groupBy("import_id")
    return rows.agg(
        F.count("*").alias("total_files"),
        good.alias("processed_files"),
        (F.count("*") - good).alias("failed_files"),
        (good / F.count("*") * 100).alias("success_rate"),
        F.sum(F.when(F.col("status") == "processed", F.col("n_strokes")).otherwise(0)).alias("created_stroke_records"),
    )
