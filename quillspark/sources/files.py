"""Reading and writing strokes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.schema import STROKE

#: Image files that an import takes.
EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tiff")
#: Those of them that Spark's image source decodes; of grays of 16 bits it would give the lower eight, so it gets no other kinds.
DECODED = ("jpg", "jpeg", "bmp")


def read_strokes_json(spark: SparkSession, path: str) -> DataFrame:
    """Strokes from JSON files, a document each; what cannot be read is kept in ``_corrupt_record``."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*STROKE.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files under a folder with the label that their path gives."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS)).withColumn("label", label_of_path(F.col("path")))


def label_of_path(path: Column) -> Column:
    """The folder, if it is one letter or digit, else the name's first one, in upper case; UNKNOWN without any."""
    folder, name = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    first = F.upper(F.regexp_extract(name, "[A-Za-z0-9]", 0))
    return F.when(folder.rlike("^[A-Za-z0-9]$"), F.upper(folder)).when(first != "", first).otherwise("UNKNOWN")


def sample_files(files: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """``count`` files in an order that a digest gives."""
    return files.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "path")), "path").limit(count)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON document; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def decoded_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``image_id, height, width, pixels`` of the JPEG and BMP files named or under a folder; no pixels for files that cannot be read."""
    from quillspark.operators import images

    found = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(paths)
    return images.from_decoder(found.where(extension(F.col("image.origin")).isin(*DECODED)))


def convert_files(spark: SparkSession, path: str, labels: list[str] | None = None, count: int | None = None, least: float = 0.0) -> DataFrame:
    """Image files under a folder as strokes: a sample first, if asked for, then those of the labels; one row per file with its
    label, its strokes or its error."""
    from quillspark.operators import images, records

    files = image_files(spark, path)
    files = sample_files(files, count) if count else files
    chosen = records.of_labels(files, labels or []).select(F.regexp_replace("path", "^file:/+", "file:/").alias("image_id"), "label", "content")
    other = extension(F.col("image_id")).isin(*DECODED)
    found = images.converted(chosen.where(~other)).unionByName(images.converted(decoded_images(spark, path).join(chosen.where(other).select("image_id"), "image_id", "left_semi")))
    return images.accepted(found, least).join(chosen.select("image_id", "label"), "image_id")
