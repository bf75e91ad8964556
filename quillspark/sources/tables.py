"""Tables of a catalog: definition, description, append, copies, look-ups of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STROKES = "id string, label string, points array<struct<x: double, y: double, time: double, pressure: double>>, quality_score double, is_validated boolean, source_type string, created_at timestamp, updated_at timestamp"
MODELS = "id long, name string, version string, model_type string, is_active boolean, validation_accuracy double, model_path string, created_at timestamp"
SESSIONS = "session_id string, status string, current_epoch int, progress double, started_at timestamp, completed_at timestamp"
IMPORTS = "import_id string, path string, total_files long, processed_files long, failed_files long, success_rate double, started_at timestamp"
DEFINITIONS = {"strokes": STROKES, "models": MODELS, "sessions": SESSIONS, "imports": IMPORTS}


def define(spark: SparkSession, prefix: str = "") -> list[str]:
    """Creates the tables that are missing, and adds columns that an older table lacks; the names of all."""
    names = []
    for name, columns in DEFINITIONS.items():
        table = f"{prefix}{name}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet")
        known = set(spark.table(table).columns)
        lacking = [f for f in T._parse_datatype_string(columns).fields if f.name not in known]
        for field in lacking:
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({field.name} {field.dataType.simpleString()})")
        names.append(table)
    return names


def drop(spark: SparkSession, prefix: str = "") -> None:
    for name in DEFINITIONS:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}{name}")


def describe(spark: SparkSession, tables: list[str]) -> DataFrame:
    """``table, position, column, kind`` of each column of the tables."""
    rows = [(table, k, f.name, f.dataType.simpleString()) for table in tables for k, f in enumerate(spark.table(table).schema)]
    return spark.createDataFrame(rows, "table string, position int, column string, kind string")


def append(rows: DataFrame, table: str) -> None:
    """Rows into a table, columns by name: unknown ones are left out, lacking ones are null."""
    target = rows.sparkSession.table(table)
    chosen = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema]
    rows.select(*chosen).write.insertInto(table)


def backup(spark: SparkSession, table: str, path: str) -> None:
    spark.table(table).write.mode("errorifexists").parquet(path)


def restore(spark: SparkSession, path: str, table: str) -> None:
    """The table as the copy has it; other rows go."""
    spark.read.schema(spark.table(table).schema).parquet(path).write.insertInto(table, overwrite=True)


def from_database(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, driver: str | None = None) -> DataFrame:
    """A database's table through JDBC, in ranges of a whole-number key so that many tasks read it."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return (reader.option("driver", driver) if driver else reader).load()


def with_file(models: DataFrame, files: DataFrame) -> DataFrame:
    """``model_file_exists``: whether the model's path is among the files (path)."""
    there = files.select(F.col("path").alias("model_path")).distinct().withColumn("there", F.lit(True))
    return models.join(there, "model_path", "left").withColumn("model_file_exists", F.coalesce("there", F.lit(False))).drop("there")
