"""Catalog rows over time: look-ups, inserts, sessions and imports with their rules, listings, and what is shown of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL_TYPES = ("cnn", "transformer", "hybrid", "deep_cnn")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tiff", "gif")


def by_fields(table: DataFrame, **wanted) -> DataFrame:
    """Rows in which every given column has the given value."""
    for name, value in wanted.items():
        table = table.where(F.col(name) == value)
    return table


def active(sessions: DataFrame, status: str = "status") -> DataFrame:
    return sessions.where(F.col(status) == "in_progress")


def recent(table: DataFrame, count: int, at: str, key: str = "id") -> DataFrame:
    """The ``count`` newest rows, as a bounded top-k."""
    return table.orderBy(F.col(at).desc(), F.col(key).desc()).limit(count)


def created(table: DataFrame, rows: DataFrame, stamp: Column, seed: str = "new") -> DataFrame:
    """``table`` with ``rows`` appended: columns that it does not have are dropped, those that they lack are null; an external
    id comes from a digest of the row, so that a second run inserts the same, and ``created_at`` is the given stamp."""
    known = [c for c in rows.columns if c in table.columns]
    digest = F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in known)))
    new = rows.select(*known).withColumn("external_id", digest).withColumn("created_at", stamp)
    return table.unionByName(new.select(*(c for c in new.columns if c in table.columns)), allowMissingColumns=True)


def session_states(events: DataFrame) -> DataFrame:
    """One row per session of events (session_id, seq, kind, progress): the last progress, 100 once complete; the status that
    the last of start, complete, fail and stop gives.

    A stop counts only where the session was in progress, that is where the event before it that set a status was a start.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    status = F.when(F.col("kind") == "start", "in_progress").when(F.col("kind") == "complete", "completed").when(F.col("kind") == "fail", "failed").when(F.col("kind") == "stop", "stopped")
    was = F.last(F.when(F.col("kind") != "stop", status), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ruled = events.withColumn("was", was).withColumn("status", F.when((F.col("kind") == "stop") & ~F.coalesce(F.col("was") == "in_progress", F.lit(False)), None).otherwise(status))
    last = lambda value, when: F.max_by(value, F.when(when, F.col("seq")))
    out = ruled.groupBy("session_id").agg(last(F.col("status"), F.col("status").isNotNull()).alias("status"), last(F.col("progress"), F.col("progress").isNotNull()).alias("progress"), F.max("seq").alias("seq"))
    return out.withColumn("progress", F.when(F.col("status") == "completed", 100.0).otherwise(F.col("progress")))


def import_status(imports: DataFrame) -> DataFrame:
    """``status`` as it is told (completed as soon as a rate is known, from the first progress on) and ``true_status``, completed
    when all files are through."""
    done = (F.col("processed") + F.col("failed") >= F.col("total")) & (F.col("total") > 0)
    return imports.withColumns({"status": F.when(F.col("success_rate").isNotNull(), "completed").otherwise("processing"), "true_status": F.when(done, "completed").otherwise("processing")})


def stopped(sessions: DataFrame, session_id) -> DataFrame:
    """Sessions with the given one stopped, if it is in progress."""
    hit = (F.col("session_id") == session_id) & (F.col("status") == "in_progress")
    return sessions.withColumn("status", F.when(hit, "stopped").otherwise(F.col("status")))


def may_start(strokes: DataFrame, model_type: str, least: int = 10) -> DataFrame:
    """Whether training may begin, and why not: an unknown type, or too few rows."""
    n = F.count("*")
    return strokes.agg(n.alias("n"), F.when(F.lit(model_type not in MODEL_TYPES), "unknown model type").when(n < least, "not enough samples").otherwise("ok").alias("verdict"))


def iso(stamp: Column) -> Column:
    """The time as text; a fraction of zero is left out."""
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(stamp, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def as_record(table: DataFrame) -> DataFrame:
    """Timestamps as ISO text; all other columns as they are."""
    times = [f.name for f in table.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    return table.withColumns({c: iso(F.col(c)) for c in times})


def model_summary(models: DataFrame, model_id) -> DataFrame:
    """Nested facts of a model: what it is, how well it does, how it was trained; no row where there is no such model."""
    info = F.struct("id", "name", "is_active")
    scores = F.struct(F.col("training_accuracy"), F.col("validation_accuracy"), F.col("test_accuracy"))
    return models.where(F.col("id") == model_id).select(info.alias("model_info"), scores.alias("performance"), F.struct(F.col("epochs_completed")).alias("training_details"))


def landmark_table(landmarks: DataFrame, kind: str | None = None, by: str = "stability") -> DataFrame:
    """Landmarks of one kind or all, with their ``place`` in the table: the firmest first, or by kind, or by x."""
    rows = landmarks.where(F.col("kind") == kind) if kind else landmarks
    keys = {"stability": F.col("stability").desc(), "kind": F.col("kind").asc(), "x": F.col("x").asc()}
    order = Window.partitionBy("stroke_id").orderBy(keys[by], "point", "kind")
    return rows.withColumn("place", F.row_number().over(order))


def landmark_summary(landmarks: DataFrame) -> DataFrame:
    """Mean stability over all, number of rows, and the kind of the largest mean (of equal ones the first by name)."""
    kinds = landmarks.groupBy("kind").agg(F.sum("stability").alias("s"), F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("s") / F.col("n")).alias("a"), F.col("kind").alias("k")))["k"]
    return kinds.agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"), best.alias("firmest"))


def previews(table: DataFrame, width: int = 50) -> DataFrame:
    """For each column of each row its type's name and its first characters."""
    shown = [F.struct(F.lit(c).alias("name"), F.expr(f"typeof(`{c}`)").alias("kind"), F.substring(F.col(c).cast("string"), 1, width).alias("preview")) for c in table.columns]
    return table.select(F.explode(F.array(*shown)).alias("s")).select("s.*")


def first_rows(table: DataFrame, count: int, key: str = "id") -> DataFrame:
    """A bounded sample in the order of the key."""
    return table.orderBy(key).limit(count)


def training_history(events: DataFrame) -> DataFrame:
    """A row per run and epoch of metrics (run, epoch, metric, value): train_loss, val_loss, train_acc, val_acc, learning_rate."""
    names = ("train_loss", "val_loss", "train_acc", "val_acc", "learning_rate")
    return events.groupBy("run", "epoch").agg(*(F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names))


def newest_packages(packages: DataFrame, keep: int, by: str = "name") -> DataFrame:
    """Packages of each name, newest first, with ``place``, and whether a clean-up that keeps ``keep`` drops them."""
    order = Window.partitionBy(by).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return packages.withColumn("place", F.row_number().over(order)).withColumn("dropped", F.col("place") > keep)


def of_labels(files: DataFrame, labels: list[str]) -> DataFrame:
    """Files of the labels, whatever their case; no labels given: all."""
    return files.where(F.upper("label").isin([x.upper() for x in labels])) if labels else files


def request_errors(name: Column, model_type: Column, labels: Column, least_quality: Column) -> tuple[Column, Column]:
    """Errors and warnings of a training request; null stands for a field that is not given, except for the name."""
    errors = F.array_compact(F.array(F.when(name.isNull(), "model_name must be a string").when(name == "", "model_name cannot be empty"), F.when(F.exists(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x.isNull()), "labels must be strings")))
    warnings = F.array_compact(F.array(F.when(~F.lower(model_type).isin(*MODEL_TYPES), F.concat(F.lit("Unknown model_type: "), model_type)), F.when((least_quality < 0) | (least_quality > 1), "min_quality should be between 0 and 1")))
    return errors, warnings


#: Fields of each kind of answer, and whether they are text (else numbers).
ANSWERS = {"training_status": {"session_id": True, "status": True, "progress_percentage": False}, "model_info": {"id": False, "name": True, "version": True}, "health_response": {"status": True, "timestamp": True}}


def answer_errors(document: Column, kind: str) -> Column:
    """Messages on a JSON document's fields that are missing or of the wrong kind."""
    if kind not in ANSWERS:
        return F.array().cast("array<string>")
    found = F.try_parse_json(document)

    def wrong(field: str, text: bool) -> Column:
        kinds = F.schema_of_variant(F.try_variant_get(found, f"$.{field}", "variant"))
        fits = kinds == "STRING" if text else kinds.rlike("^(BIGINT|DECIMAL|DOUBLE)")
        return F.when(~F.coalesce(fits, F.lit(False)), f"{field} must be a {'string' if text else 'number'}")

    return F.array_compact(F.array(*(wrong(f, text) for f, text in ANSWERS[kind].items())))


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)


def holds_strokes(points: Column) -> Column:
    """Whether an array of text maps has two points or more, each with x, y and time that read as numbers."""
    fits = lambda p: F.forall(F.array(*map(F.lit, ("x", "y", "time"))), lambda k: F.try_element_at(p, k).try_cast("double").isNotNull())
    return F.coalesce(F.size(points) >= 2, F.lit(False)) & F.coalesce(F.forall(points, fits), F.lit(False))
