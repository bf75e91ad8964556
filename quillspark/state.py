"""Tables in the folder that driver and tasks share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of this machine on a local master, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_unions(spark: SparkSession) -> None:
    """Unions are to claim no partitioning of their own.  In Spark 4.1 a union of branches of one dealt table claims their
    common partitioning where it does not hold, and a grouping after it then gives a key several rows."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into twice as many parts as the session shuffles to, and no fewer than twice its cores.

    For procedures that cost far more than their rows' bytes: adaptive execution merges small parts by bytes and would run them
    in one task, but leaves a stated number alone.  The number differs from that of other shuffles, as one that repeats the
    partitioning below it would be dropped, and the parts below merged after all.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(2 * parts, *keys)
