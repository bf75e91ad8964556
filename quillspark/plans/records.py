"""Queries on records over time: sessions, imports, listings, requests; each SQL form in a block of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import features as B
from quillspark.operators import records as C
from quillspark.plans.bundles import LANDMARKS
from quillspark.plans.registry import query, rounded
from quillspark.plans.strokes import pts
from quillspark.schema import catalog_models, catalog_strokes, read

KIND = {"signup": "start", "purchase": "complete", "error": "fail", "click": "stop", "view": "progress"}


def sessions(spark, sf_dir):
    """Orders as training sessions: F completed, O in progress, P pending."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("pending")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"))


SESSIONS = """s AS (SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'pending' END AS status, o_orderdate AS started_at FROM orders)"""


@query("rel05_by_name_and_owner", "SELECT id, name, owner FROM cm WHERE name = '5-LOW' AND owner = 89", "cm")
def _(spark, sf_dir):
    return C.by_fields(catalog_models(spark, sf_dir), name="5-LOW", owner=89).select("id", "name", "owner")


@query("rel08_active_sessions", f"WITH {SESSIONS} SELECT * FROM s WHERE status = 'in_progress'")
def _(spark, sf_dir):
    return C.active(sessions(spark, sf_dir))


@query("rel09_recent_sessions", f"WITH {SESSIONS} SELECT * FROM s ORDER BY started_at DESC, session_id DESC LIMIT 10")
def _(spark, sf_dir):
    return C.recent(sessions(spark, sf_dir), 10, "started_at", "session_id")


@query("rel10_created", """SELECT id, label, NULL::VARCHAR AS external_id, quality_score FROM cs
UNION ALL SELECT o_custkey, o_orderpriority, md5('new|' || o_custkey || '|' || o_orderpriority || '|' || floor(o_totalprice)::BIGINT::VARCHAR), floor(o_totalprice) FROM orders""", "cs")
def _(spark, sf_dir):
    table = catalog_strokes(spark, sf_dir).select("id", "label", F.lit(None).cast("string").alias("external_id"), "quality_score")
    whole = F.floor("o_totalprice").cast("long")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("label"), whole.alias("quality_score"), F.lit(1).alias("unknown_key"))
    return C.created(table, rows, F.lit("2024-01-01").cast("timestamp_ntz"))


@query("rel13_session_states", """WITH e AS (
  SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'click' THEN 'stop' ELSE 'progress' END AS kind,
         CASE WHEN event_type = 'view' THEN value END AS progress FROM events),
k AS (SELECT *, CASE kind WHEN 'start' THEN 'in_progress' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' WHEN 'stop' THEN 'stopped' END AS st FROM e),
w AS (SELECT *, last_value(CASE WHEN kind <> 'stop' THEN st END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM k),
r AS (SELECT *, CASE WHEN kind = 'stop' AND was IS DISTINCT FROM 'in_progress' THEN NULL ELSE st END AS status FROM w),
g AS (SELECT session_id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(progress, seq) FILTER (progress IS NOT NULL) AS progress, max(seq) AS seq FROM r GROUP BY 1)
SELECT session_id, status, CASE WHEN status = 'completed' THEN 100 ELSE progress END AS progress, seq FROM g""")
def _(spark, sf_dir):
    kind = F.create_map(*(F.lit(x) for pair in KIND.items() for x in pair))[F.col("event_type")]
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_type") == "view", F.col("value")).alias("progress"))
    return C.session_states(events)


@query("rel15_import_status", """WITH i AS (SELECT o_custkey AS import_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS processed, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1)
SELECT import_id, CASE WHEN processed > 0 THEN 'completed' ELSE 'processing' END AS status, CASE WHEN processed + failed >= total AND total > 0 THEN 'completed' ELSE 'processing' END AS true_status FROM i""")
def _(spark, sf_dir):
    count = lambda s: F.count_if(F.col("o_orderstatus") == s)
    imports = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("import_id")).agg(F.count("*").alias("total"), count("F").alias("processed"), count("P").alias("failed"))
    rate = F.when(F.col("processed") > 0, F.col("processed") / F.col("total") * 100)
    return C.import_status(imports.withColumn("success_rate", rate)).select("import_id", "status", "true_status")


@query("rel16_stopped", f"WITH {SESSIONS} SELECT session_id, CASE WHEN session_id IN (2, 7) AND status = 'in_progress' THEN 'stopped' ELSE status END AS status FROM s")
def _(spark, sf_dir):
    return C.stopped(C.stopped(sessions(spark, sf_dir), 2), 7).select("session_id", "status")


@query("ml14_may_start", "SELECT count(*) AS n, CASE WHEN count(*) < 10 THEN 'not enough samples' ELSE 'ok' END AS verdict FROM cs WHERE is_validated", "cs")
def _(spark, sf_dir):
    return C.may_start(catalog_strokes(spark, sf_dir).where("is_validated"), "hybrid")


@query("rel18_records", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END AS ts FROM events")
def _(spark, sf_dir):
    return C.as_record(read(spark, sf_dir, "events").select("event_id", "ts"))


@query("rel21_model_summary", "SELECT id, name, is_active, validation_accuracy FROM cm WHERE id = 17", "cm")
def _(spark, sf_dir):
    none = F.lit(None).cast("double")
    models = catalog_models(spark, sf_dir).withColumns({"training_accuracy": none, "test_accuracy": none, "epochs_completed": F.lit(None).cast("int")})
    return C.model_summary(models, 17).select("model_info.*", "performance.validation_accuracy")


@query("rel22_landmark_table", f"""SELECT stroke_id, point, kind, stability, (row_number() OVER (PARTITION BY stroke_id ORDER BY stability DESC, point, kind))::INT AS place FROM ({LANDMARKS}) WHERE kind <> ''""", "strokes rob")
def _(spark, sf_dir):
    return C.landmark_table(B.landmarks(pts(spark, sf_dir))).select("stroke_id", "point", "kind", "stability", "place")


@query("agg09_landmark_summary", f"SELECT round(avg(stability), 6) AS mean, count(*) AS n, 'endpoint' AS firmest FROM ({LANDMARKS})", "strokes rob")
def _(spark, sf_dir):
    return rounded(C.landmark_summary(B.landmarks(pts(spark, sf_dir))))


@query("rel23_previews", """SELECT 'c_custkey' AS name, 'bigint' AS kind, (c_custkey::VARCHAR)[:50] AS preview FROM customer UNION ALL SELECT 'c_name', 'string', c_name[:50] FROM customer""")
def _(spark, sf_dir):
    return C.previews(read(spark, sf_dir, "customer").select("c_custkey", "c_name"))


@query("top08_first_rows", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 1000")
def _(spark, sf_dir):
    return C.first_rows(read(spark, sf_dir, "embeddings").select("vec_id", "label"), 1000, "vec_id")


@query("ev12_training_history", """WITH h AS (SELECT user_id AS run, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 + 1 AS epoch, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 5 AS m, value FROM events)
SELECT run, epoch, max(value) FILTER (m = 0) AS train_loss, max(value) FILTER (m = 1) AS val_loss, max(value) FILTER (m = 2) AS train_acc, max(value) FILTER (m = 3) AS val_acc, max(value) FILTER (m = 4) AS learning_rate FROM h GROUP BY 1, 2""")
def _(spark, sf_dir):
    k = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    names = F.array(*map(F.lit, ("train_loss", "val_loss", "train_acc", "val_acc", "learning_rate")))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), k.alias("k"), "value")
    return C.training_history(rows.select("run", (F.floor(F.col("k") / 5) + 1).alias("epoch"), F.get(names, (F.col("k") % 5).cast("int")).alias("metric"), "value"))


@query("snk06_newest_packages", "SELECT id, name, (row_number() OVER w)::INT AS place, row_number() OVER w > 50 AS dropped FROM cm WINDOW w AS (PARTITION BY name ORDER BY created_at DESC, id DESC)", "cm")
def _(spark, sf_dir):
    return C.newest_packages(catalog_models(spark, sf_dir), 50).select("id", "name", "place", "dropped")


@query("src07_files_of_labels", "SELECT doc_id, lang AS label FROM documents WHERE upper(lang) IN ('EN', 'FR')")
def _(spark, sf_dir):
    return C.of_labels(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label")), ["en", "Fr"])


@query("val03_requests", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN ['model_name cannot be empty'] ELSE [] END AS errors,
       list_concat(CASE WHEN o_orderpriority <> '5-LOW' THEN ['Unknown model_type: ' || o_orderpriority] ELSE [] END, CASE WHEN o_totalprice / 300000 > 1 THEN ['min_quality should be between 0 and 1'] ELSE [] END) AS warnings FROM orders""")
def _(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "CNN").otherwise(F.col("o_orderpriority"))
    errors, warnings = C.request_errors(name, kind, F.array("o_orderstatus"), F.col("o_totalprice") / 300000)
    return orders.select(F.col("o_orderkey").alias("id"), errors.alias("errors"), warnings.alias("warnings"))


@query("val03_answers", """SELECT event_id, list_filter([CASE WHEN event_id % 3 = 0 THEN 'session_id must be a string' END, CASE WHEN event_type = 'error' THEN 'status must be a string' END, CASE WHEN event_id % 5 = 0 THEN 'progress_percentage must be a number' END], lambda m: m IS NOT NULL) AS errors FROM events""")
def _(spark, sf_dir):
    # answers of events: some lack the session, errors have a number for their status, some have text for their progress
    events = read(spark, sf_dir, "events")
    session = F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string"))
    status = F.when(F.col("event_type") == "error", F.to_json(F.struct(F.lit(500).alias("status")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("status"))))
    part = F.when(F.col("event_id") % 5 == 0, F.to_json(F.struct(F.lit("x").alias("progress_percentage")))).otherwise(F.to_json(F.struct(F.col("value").alias("progress_percentage"))))
    inner = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    parts = events.select("event_id", F.to_json(F.struct(session.alias("session_id"))).alias("a"), status.alias("b"), part.alias("c"))
    answer = F.concat(F.lit("{"), F.array_join(F.filter(F.array(inner("a"), inner("b"), inner("c")), lambda x: x != ""), ","), F.lit("}"))
    return parts.select("event_id", C.answer_errors(answer, "training_status").alias("errors"))


@query("val05_images", "SELECT page_id, regexp_matches(lower(url), '\\.(png|jpg|jpeg|bmp|tiff|gif)$') AS ok FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '/a.PNG' WHEN 1 THEN '/b.gif' ELSE '/c.txt' END AS url FROM pages)")
def _(spark, sf_dir):
    tail = F.when(F.col("page_id") % 3 == 0, "/a.PNG").when(F.col("page_id") % 3 == 1, "/b.gif").otherwise("/c.txt")
    return read(spark, sf_dir, "pages").select("page_id", C.is_image(F.concat("url", tail)).alias("ok"))


@query("val05_stroke_data", "SELECT user_id, count(*) >= 2 AND bool_and(value >= 0.5) AS ok FROM events GROUP BY 1")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    point = F.create_map(F.lit("x"), F.col("value").cast("string"), F.lit("y"), F.when(F.col("value") < 0.5, "not a number").otherwise("1.5"), F.lit("time"), F.col("event_id").cast("string"))
    return rows.groupBy("user_id").agg(F.collect_list(point).alias("points")).select("user_id", C.holds_strokes(F.col("points")).alias("ok"))
