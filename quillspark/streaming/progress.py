"""Progress of imports and trainings as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "stopped")


def open_runs(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The newest state of each run (run, ts, status, progress) within an hour of its start, whose state then leaves memory."""
    hour = F.window("ts", "1 hour")
    marked = events.withWatermark("ts", late).groupBy(hour, "run").agg(F.max_by(F.struct("status", "progress"), F.col("ts")).alias("s"))
    return marked.select(F.col("window.start").alias("since"), "run", "s.status", "s.progress", F.col("s.status").isin(*TERMINAL).alias("ended"))


def told_once(folder: str, sink: Callable[[int, int], None], step: int = 10) -> Callable[[DataFrame, int], None]:
    """A batch function for streams of converted files (status): tells processed and failed totals each time ``step`` more files are
    through.

    The counts of each batch are a table of their own in ``folder``, named by the batch's number, and totals are sums of these;
    a batch whose totals were told leaves a mark.  So a restart goes on from the same numbers, and a batch that is done again
    counts once and, unless the sink itself failed, is told once.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.groupBy("status").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")
        counts = spark.read.schema("status string, n long, batch long").option("basePath", f"{folder}/counts").parquet(f"{folder}/counts").where(F.col("batch") <= number)
        total = lambda good, before: F.coalesce(F.sum(F.when((F.col("status") == "processed") == good, F.when(F.col("batch") < number if before else F.lit(True), F.col("n")))), F.lit(0))
        done, failed, done_before, failed_before = counts.agg(total(True, False).alias("a"), total(False, False).alias("b"), total(True, True).alias("c"), total(False, True).alias("d")).first()
        if (done + failed) // step > (done_before + failed_before) // step and not _marked(spark, f"{folder}/told", number):
            sink(done, failed)
            spark.range(number, number + 1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/told/batch={number}")

    return take


def _marked(spark: SparkSession, folder: str, number: int) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={number}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
