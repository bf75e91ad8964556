"""Filters, summaries, rankings and updates of the catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_id(table: DataFrame, value, key: str = "id") -> DataFrame:
    return table.where(F.col(key) == value).limit(1)


def page(table: DataFrame, skip: int = 0, limit: int = 100, label: str | None = None, validated: bool = False, order=("id",)) -> DataFrame:
    """A page of the table; an empty label is no filter."""
    if label:
        table = table.where(F.col("label") == label)
    if validated:
        table = table.where("is_validated")
    return table.orderBy(*order).offset(skip).limit(limit)


def training_rows(strokes: DataFrame, labels: list[str] | None, least: float, validated: bool = True) -> DataFrame:
    """Rows of at least this quality (null fails), of the given labels (none given: all), validated if asked for."""
    rows = strokes.where(F.col("quality_score") >= least)
    rows = rows.where(F.col("label").isin(labels)) if labels else rows
    return rows.where("is_validated") if validated else rows


def default_quality(col: str) -> Column:
    """Null and 0 become .8."""
    return F.when(F.col(col).isNull() | (F.col(col) == 0), 0.8).otherwise(F.col(col))


def latest(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The last state of each key, by ``seq``: an aggregation, so a key with very many events is combined before the shuffle."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("s")).select(key, "s.*")


def label_distribution(strokes: DataFrame) -> DataFrame:
    return strokes.groupBy("label").agg(F.count("id").alias("n"))


def quality_statistics(strokes: DataFrame) -> DataFrame:
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    q = "quality_score"
    return strokes.agg(zero(F.avg(q)).alias("mean"), zero(F.min(q)).alias("low"), zero(F.max(q)).alias("high"), F.count(q).alias("n"))


def dataset_statistics(strokes: DataFrame) -> DataFrame:
    """Totals in one pass: rows, validated ones and their share in per cent, labels, mean quality with .8 for none."""
    valid = F.count_if("is_validated")
    return strokes.agg(F.count("*").alias("total"), valid.alias("validated"), F.when(F.count("*") > 0, valid / F.count("*") * 100).otherwise(0.0).alias("rate"), F.countDistinct("label").alias("labels"), F.avg(default_quality("quality_score")).alias("mean_quality"))


def balance(strokes: DataFrame) -> DataFrame:
    """Count, share and weight n / (k n_c) of each label, and whether all shares lie in [.1, .9]."""
    counts = strokes.groupBy("label").agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # a row per label
    share = F.col("n") / F.sum("n").over(every)
    rows = counts.select("label", "n", share.alias("share"), (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))
    return rows.withColumn("even", F.min(F.col("share").between(0.1, 0.9)).over(every))


def best(models: DataFrame, metric: str) -> DataFrame:
    return models.where(F.col("is_active") & F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), "id").limit(1)


def deactivate_old(models: DataFrame, keep: int) -> DataFrame:
    """All but the ``keep`` newest models become inactive.  The newest are found as a bounded top-k, not by ranking all."""
    newest = models.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(keep).select("id", F.lit(True).alias("new"))
    return models.join(F.broadcast(newest), "id", "left").withColumn("is_active", F.col("is_active") & F.coalesce("new", F.lit(False))).drop("new")  # at most ``keep`` rows


def top_per_label(rows: DataFrame, label: str, score: str, count: int) -> DataFrame:
    order = Window.partitionBy(label).orderBy(F.col(score).desc(), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def export_estimate(size: Column) -> Column:
    """Megabytes of a package: the model's bytes and 2048 more."""
    return F.round((2048 + F.coalesce(size, F.lit(0))) / 1024 / 1024, 2)


def batch_status(wanted: DataFrame, models: DataFrame) -> DataFrame:
    """For each wanted id 'ready' if there is an active model, else 'failed'."""
    joined = wanted.join(models.select("id", "is_active"), "id", "left")
    return joined.select("id", F.when(F.col("is_active"), "ready").otherwise("failed").alias("status"))


def import_progress(col_processed: Column, col_total: Column, previous: Column) -> Column:
    return F.when(col_total > 0, col_processed / col_total * 100).otherwise(previous)
