"""Changes of stored tables: rows set or removed by key, and only the touched parts of a table written anew.

A table is a folder of Parquet files in parts by a digest of its key.  A change reads the parts that hold its keys, puts the new
rows beside those that stay, and overwrites just these parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "part_of_key"


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(parts)).cast("int")


def store(rows: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """A new table of ``rows``; an error where there is one already."""
    out = rows.withColumn(PART, _part(F.col(key), parts))
    out.repartition(parts, PART).write.mode("errorifexists").partitionBy(PART).parquet(path)


def load(spark: SparkSession, path: str, schema) -> DataFrame:
    return _with_part(schema, spark, path).drop(PART)


def _overwrite(rows: DataFrame, path: str) -> None:
    rows.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def _touched(table: DataFrame, keys: DataFrame, parts: int) -> DataFrame:
    """The rows of the parts that hold ``keys``, without theirs; parts are few, so their numbers are sent to all tasks."""
    numbers = [r[0] for r in keys.select(_part(F.col(keys.columns[0]), parts)).distinct().collect()]  # no more than parts
    return table.where(F.col(PART).isin(numbers))


def _with_part(schema, spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql import types as T

    fields = [f for f in schema.fields if f.name != PART]
    return spark.read.schema(T.StructType([*fields, T.StructField(PART, T.IntegerType())])).parquet(path)


def append(rows: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """More rows, in new files of their parts."""
    rows.withColumn(PART, _part(F.col(key), parts)).repartition(PART).write.mode("append").partitionBy(PART).parquet(path)


def update(changes: DataFrame, path: str, schema, key: str, stamp: Column | None = None, stamp_col: str = "updated_at", parts: int = 64) -> None:
    """Sets the fields that ``changes`` has, by key; unknown fields are left out, null ones too, and keys that are not there.

    ``stamp``, if given, goes into ``stamp_col`` of each row that is changed.  A key that ``changes`` repeats must have one row:
    of several any one counts.
    """
    spark = changes.sparkSession
    table = _with_part(schema, spark, path)
    fields = [c for c in changes.columns if c in table.columns and c != key]
    new = changes.where(F.col(key).isNotNull()).dropDuplicates([key]).select(F.col(key), F.struct(*(F.col(c).cast(table.schema[c].dataType).alias(c) for c in fields)).alias("new"))
    held = _touched(table, new.select(key), parts).join(new, key, "left")
    found = F.col("new").isNotNull()
    values = {c: F.coalesce(F.col(f"new.{c}"), F.col(c)) for c in fields}
    if stamp is not None:
        values[stamp_col] = F.when(found, stamp).otherwise(F.col(stamp_col))
    _overwrite(held.select(*(values[c].alias(c) if c in values else F.col(c) for c in table.columns)), path)


def delete(keys: DataFrame, path: str, schema, key: str, parts: int = 64) -> int:
    """Removes rows by key; how many went.  A part that loses all its rows is left as one empty file."""
    spark = keys.sparkSession
    table = _with_part(schema, spark, path)
    gone = keys.select(F.col(keys.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    held = _touched(table, gone, parts)
    marked = held.join(gone.withColumn("gone", F.lit(True)), key, "left")
    removed = marked.where("gone").select(PART, key)
    count = removed.count()
    if not count:
        return 0
    left = marked.where("gone is null").select(*table.columns)
    emptied = [r[0] for r in removed.select(PART).distinct().join(left.select(PART).distinct(), PART, "left_anti").collect()]  # no more than parts
    _overwrite(left, path)
    for number in emptied:  # dynamic overwriting leaves parts without new rows as they are
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PART}={number}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return count
