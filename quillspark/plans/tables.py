"""Queries on the catalog, on predictions and on vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import catalog as C
from quillspark.operators import embedding as M
from quillspark.operators import evaluation as E
from quillspark.plans.registry import query, rounded
from quillspark.schema import catalog_models, catalog_strokes, predictions, read

R = lambda e, a: f"round({e}, 6) + 0.0 AS {a}"
ROW = "id, label, source_type, quality_score, is_validated, n_points"


@query("rel01_by_id", f"SELECT {ROW} FROM cs WHERE id = 17", "cs")
def _(spark, sf_dir):
    return C.by_id(catalog_strokes(spark, sf_dir), 17)


@query("rel03_page", f"SELECT {ROW} FROM cs WHERE label = 'en' AND is_validated ORDER BY id LIMIT 50 OFFSET 20", "cs")
def _(spark, sf_dir):
    return C.page(catalog_strokes(spark, sf_dir), 20, 50, "en", True)


@query("rel04_count", "SELECT count(id) AS n FROM cs WHERE label = 'fr' AND is_validated", "cs")
def _(spark, sf_dir):
    return catalog_strokes(spark, sf_dir).where("label = 'fr' and is_validated").agg(F.count("id").alias("n"))


@query("rel06_models", "SELECT id, name, created_at FROM cm WHERE is_active ORDER BY created_at DESC, id DESC LIMIT 20", "cm")
def _(spark, sf_dir):
    return catalog_models(spark, sf_dir).where("is_active").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(20).select("id", "name", "created_at")


@query("rel07_training_rows", f"SELECT {ROW} FROM cs WHERE quality_score >= 0.5 AND label IN ('en', 'de') AND is_validated", "cs")
def _(spark, sf_dir):
    return C.training_rows(catalog_strokes(spark, sf_dir), ["en", "de"], 0.5)


@query("rel11_update", "SELECT id, CASE WHEN id = 5 THEN 'xx' ELSE label END AS label FROM cs", "cs")
def _(spark, sf_dir):
    return catalog_strokes(spark, sf_dir).select("id", F.when(F.col("id") == 5, "xx").otherwise(F.col("label")).alias("label"))


@query("rel12_delete", "SELECT id, label FROM cs WHERE id <> 5", "cs")
def _(spark, sf_dir):
    return catalog_strokes(spark, sf_dir).where("id <> 5").select("id", "label")


@query("rel13_latest_state", "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def _(spark, sf_dir):
    return C.latest(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("rel14_progress", "SELECT o_custkey, CASE WHEN count(*) > 0 THEN count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) * 100 END AS success_rate FROM orders GROUP BY 1")
def _(spark, sf_dir):
    done = F.count_if(F.col("o_orderstatus") == "F").cast("double")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(C.import_progress(done, F.count("*"), F.lit(None).cast("double")).alias("success_rate"))


@query("rel19_duration", "SELECT id, date_diff('second', created_at, TIMESTAMP '2030-01-01') AS seconds FROM cm", "cm")
def _(spark, sf_dir):
    return catalog_models(spark, sf_dir).select("id", F.expr("timestampdiff(SECOND, created_at, timestamp_ntz'2030-01-01')").alias("seconds"))


@query("src11_default_quality", "SELECT id, CASE WHEN quality_score IS NULL OR quality_score = 0 THEN 0.8::DOUBLE ELSE quality_score END AS quality FROM cs", "cs")
def _(spark, sf_dir):
    return catalog_strokes(spark, sf_dir).select("id", C.default_quality("quality_score").alias("quality"))


@query("jn01_models_of_owners", "SELECT c_custkey, c_name, id FROM customer LEFT JOIN cm ON owner = c_custkey", "cm")
def _(spark, sf_dir):
    models = catalog_models(spark, sf_dir).select("id", F.col("owner").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(models, "c_custkey", "left")


@query("jn19_batch_status", "SELECT c_custkey::BIGINT AS id, CASE WHEN is_active THEN 'ready' ELSE 'failed' END AS status FROM customer LEFT JOIN cm ON id = c_custkey", "cm")
def _(spark, sf_dir):
    return C.batch_status(read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id")), catalog_models(spark, sf_dir))


@query("agg01_label_distribution", "SELECT label, count(id) AS n FROM cs GROUP BY 1", "cs")
def _(spark, sf_dir):
    return C.label_distribution(catalog_strokes(spark, sf_dir))


@query("agg02_quality_statistics", f"SELECT {R('coalesce(avg(quality_score), 0)', 'mean')}, coalesce(min(quality_score), 0) AS low, coalesce(max(quality_score), 0) AS high, count(quality_score) AS n FROM cs", "cs")
def _(spark, sf_dir):
    return rounded(C.quality_statistics(catalog_strokes(spark, sf_dir)))


@query("agg03_dataset_statistics", f"SELECT count(*) AS total, count(*) FILTER (is_validated) AS validated, {R('count(*) FILTER (is_validated)::DOUBLE / count(*) * 100', 'rate')}, count(DISTINCT label) AS labels, {R('avg(CASE WHEN quality_score IS NULL OR quality_score = 0 THEN 0.8::DOUBLE ELSE quality_score END)', 'mean_quality')} FROM cs", "cs")
def _(spark, sf_dir):
    return rounded(C.dataset_statistics(catalog_strokes(spark, sf_dir)))


@query("agg04_balance", f"WITH c AS (SELECT label, count(*) AS n FROM cs GROUP BY 1), d AS (SELECT *, n::DOUBLE / sum(n) OVER () AS sh FROM c) SELECT label, n, {R('sh', 'share')}, {R('sum(n) OVER ()::DOUBLE / (count(*) OVER () * n)', 'weight')}, bool_and(sh BETWEEN 0.1 AND 0.9) OVER () AS even FROM d", "cs")
def _(spark, sf_dir):
    return rounded(C.balance(catalog_strokes(spark, sf_dir)))


@query("agg06_feature_statistics", f"SELECT (i)::INT AS pos, {R('avg(v)', 'mean')}, {R('stddev_pop(v)', 'deviation')}, {R('min(v)', 'low')}, {R('max(v)', 'high')} FROM (SELECT i, embedding[i+1]::DOUBLE AS v FROM embeddings, range(64) r(i)) GROUP BY 1")
def _(spark, sf_dir):
    return rounded(E.feature_statistics(read(spark, sf_dir, "embeddings"), "embedding"))


@query("agg17_outcomes", "SELECT source_type, count(*) FILTER (quality_score > 0) AS succeeded, count(*) FILTER (quality_score = 0) AS failed FROM cs GROUP BY 1", "cs")
def _(spark, sf_dir):
    return catalog_strokes(spark, sf_dir).groupBy("source_type").agg(F.count_if(F.col("quality_score") > 0).alias("succeeded"), F.count_if(F.col("quality_score") == 0).alias("failed"))


@query("top01_best_model", "SELECT id, validation_accuracy FROM cm WHERE is_active ORDER BY validation_accuracy DESC, id LIMIT 1", "cm")
def _(spark, sf_dir):
    return C.best(catalog_models(spark, sf_dir), "validation_accuracy").select("id", "validation_accuracy")


@query("top02_deactivate_old", "SELECT id, is_active AND row_number() OVER (ORDER BY created_at DESC, id DESC) <= 500 AS is_active FROM cm", "cm")
def _(spark, sf_dir):
    return C.deactivate_old(catalog_models(spark, sf_dir), 500).select("id", "is_active")


@query("top04_top_per_label", "SELECT id, name, validation_accuracy FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY validation_accuracy DESC, id) AS rn FROM cm) WHERE rn <= 20", "cm")
def _(spark, sf_dir):
    return C.top_per_label(catalog_models(spark, sf_dir), "name", "validation_accuracy", 20).select("id", "name", "validation_accuracy")


@query("snk05_export_estimate", "SELECT id, name, round((2048 + coalesce(owner, 0)) / 1024.0::DOUBLE / 1024, 2) AS mb FROM cm", "cm")
def _(spark, sf_dir):
    return catalog_models(spark, sf_dir).select("id", "name", C.export_estimate(F.col("owner")).alias("mb"))


@query("ml01_stratified_split", "SELECT id, label, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM cs)", "cs")
def _(spark, sf_dir):
    return E.stratified_split(catalog_strokes(spark, sf_dir).select("id", "label"))


@query("ml04_label_codes", "SELECT id, (dense_rank() OVER (ORDER BY label) - 1)::INT AS code FROM cs", "cs")
def _(spark, sf_dir):
    return E.label_codes(catalog_strokes(spark, sf_dir)).select("id", "code")


@query("ml05_standardised", f"WITH l AS (SELECT vec_id, i, embedding[i+1]::DOUBLE AS v FROM embeddings, range(64) r(i)), s AS (SELECT *, (v - avg(v) OVER (PARTITION BY i)) / CASE WHEN stddev_pop(v) OVER (PARTITION BY i) = 0 THEN 1 ELSE stddev_pop(v) OVER (PARTITION BY i) END AS z FROM l) SELECT vec_id, i::INT AS pos, {R('z', 'z')} FROM s")
def _(spark, sf_dir):
    scaled = E.standardised(read(spark, sf_dir, "embeddings"), "embedding")
    return rounded(scaled.select("vec_id", F.posexplode("scaled").alias("pos", "z")))


@query("ev01_accuracy", f"SELECT {R('avg((target = predicted)::INT)', 'accuracy')}, {R('avg((len(list_filter(p, lambda q: q > p[target+1])) < 3)::INT)', 'top3')}, {R('avg((len(list_filter(p, lambda q: q > p[target+1])) < 5)::INT)', 'top5')} FROM pr", "pr")
def _(spark, sf_dir):
    return rounded(E.accuracy(predictions(spark, sf_dir)))


@query("ev04_confusion", "SELECT target, predicted, count(*) AS n FROM pr GROUP BY 1, 2", "pr")
def _(spark, sf_dir):
    return E.confusion(predictions(spark, sf_dir))


SCORES = "SELECT c, support, pc AS precision, rc AS recall, CASE WHEN pc + rc > 0 THEN 2*pc*rc/(pc+rc) ELSE 0 END AS f1 FROM (SELECT c, (SELECT count(*) FROM pr WHERE target = c) AS support, coalesce((SELECT avg((target = c)::INT) FROM pr WHERE predicted = c), 0) AS pc, coalesce((SELECT avg((predicted = c)::INT) FROM pr WHERE target = c), 0) AS rc FROM (SELECT target AS c FROM pr UNION SELECT predicted FROM pr))"


@query("ev02_class_scores", f"SELECT c, support, {R('precision', 'precision')}, {R('recall', 'recall')}, {R('f1', 'f1')} FROM ({SCORES})", "pr")
def _(spark, sf_dir):
    return rounded(E.class_scores(predictions(spark, sf_dir)))


@query("ev03_averages", "SELECT " + ", ".join([R(f"avg({n})", f"macro_{n}") for n in ("precision", "recall", "f1")] + [R(f"sum({n}*support)/sum(support)", f"weighted_{n}") for n in ("precision", "recall", "f1")]) + f" FROM ({SCORES})", "pr")
def _(spark, sf_dir):
    return rounded(E.averages(E.class_scores(predictions(spark, sf_dir))))


AREA = """SELECT c, sum(CASE WHEN b.target = c THEN 0 ELSE 1 END * CASE WHEN a.p[c + 1] > b.p[c + 1] THEN 1 WHEN a.p[c + 1] = b.p[c + 1] THEN 0.5::DOUBLE ELSE 0 END)
  / sum(CASE WHEN b.target = c THEN 0 ELSE 1 END) AS area, count(DISTINCT a.id) AS support
FROM pr a, pr b, range(10) r(c) WHERE a.target = c GROUP BY 1"""


@query("ev06_ranking_areas", f"SELECT c::INT AS c, support, {R('area', 'area')} FROM ({AREA})", "pr")
def _(spark, sf_dir):
    return rounded(E.ranking_areas(predictions(spark, sf_dir)))


@query("ev06_weighted_area", f"SELECT {R('sum(area * support) / sum(support)', 'area')} FROM ({AREA})", "pr")
def _(spark, sf_dir):
    return rounded(E.weighted_area(E.ranking_areas(predictions(spark, sf_dir))))


@query("ev05_report", f"""WITH s AS ({SCORES})
SELECT c::VARCHAR AS name, {R('precision', 'precision')}, {R('recall', 'recall')}, {R('f1', 'f1')}, support FROM s
UNION ALL SELECT 'macro avg', {R('avg(precision)', 'precision')}, {R('avg(recall)', 'recall')}, {R('avg(f1)', 'f1')}, sum(support)::BIGINT FROM s
UNION ALL SELECT 'weighted avg', {R('sum(precision * support) / sum(support)', 'precision')}, {R('sum(recall * support) / sum(support)', 'recall')}, {R('sum(f1 * support) / sum(support)', 'f1')}, sum(support)::BIGINT FROM s""", "pr")
def _(spark, sf_dir):
    return rounded(E.report(E.class_scores(predictions(spark, sf_dir))))


@query("ev10_evaluation", f"""WITH s AS ({SCORES}), a AS ({AREA})
SELECT (SELECT count(*) FROM pr) AS n, (SELECT round(avg((target = predicted)::INT), 6) FROM pr) AS accuracy, (SELECT round(sum(f1 * support) / sum(support), 6) FROM s) AS weighted_f1,
       (SELECT round(sum(area * support) / sum(support), 6) FROM a) AS area, (SELECT round(avg(list_max(p)), 6) FROM pr) AS confidence""", "pr")
def _(spark, sf_dir):
    return rounded(E.evaluation(predictions(spark, sf_dir)))


@query("ev09_calibration", f"SELECT floor(c*10)::INT AS bin, count(*) AS n, {R('avg(c)', 'confidence')}, {R('avg(r)', 'accuracy')} FROM (SELECT list_max(p) AS c, (target = predicted)::INT AS r FROM pr) WHERE c < 1 GROUP BY 1", "pr")
def _(spark, sf_dir):
    return rounded(E.calibration(predictions(spark, sf_dir)))


@query("ev09_calibration_error", f"SELECT {R('sum(n*abs(c-r))/sum(n)', 'ece')} FROM (SELECT floor(list_max(p)*10) AS bin, count(*) AS n, avg(list_max(p)) AS c, avg((target = predicted)::INT) AS r FROM pr WHERE list_max(p) < 1 GROUP BY 1)", "pr")
def _(spark, sf_dir):
    return rounded(E.calibration_error(E.calibration(predictions(spark, sf_dir))))


@query("ml15_early_stopping", "WITH h AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value AS loss FROM events), b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM h) SELECT run, epoch, epoch - max(CASE WHEN m IS NULL OR loss < m THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS since FROM b")
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    history = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).cast("long").alias("epoch"), F.col("value").alias("loss"))
    return E.early_stopping(history, 15).select("run", "epoch", "since")


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))


DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda j: (a.embedding[j]::DOUBLE - b.embedding[j]::DOUBLE) * (a.embedding[j]::DOUBLE - b.embedding[j]::DOUBLE))))"
CITY = "list_sum(list_transform(range(1, 65), lambda j: abs(a.embedding[j]::DOUBLE - b.embedding[j]::DOUBLE)))"


def knn(which: str = "", dist: str = DIST) -> str:
    """The five nearest of all other rows."""
    return f"""SELECT * FROM (
  SELECT id, other, d, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank
  FROM (SELECT a.vec_id AS id, b.vec_id AS other, {dist} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id {which}))
WHERE rank <= 5"""


#: Bisection of sigma, as the operator does it.
FUZZY = """e AS (SELECT *, min(d) OVER (PARTITION BY id) AS rho FROM knn),
l AS (SELECT id, rho, list(d ORDER BY rank) AS ds FROM e GROUP BY 1, 2),
s AS (
  SELECT id, list_reduce(range(64), lambda s, j:
    CASE WHEN s.done OR abs(list_sum(list_transform(ds, lambda d: exp(-greatest(d - rho, 0) / ((s.lo + s.hi) / 2)))) - log2(5.0::DOUBLE)) < 1e-5 THEN {lo: s.lo, hi: s.hi, done: true}
         WHEN list_sum(list_transform(ds, lambda d: exp(-greatest(d - rho, 0) / ((s.lo + s.hi) / 2)))) > log2(5.0::DOUBLE) THEN {lo: s.lo, hi: (s.lo + s.hi) / 2, done: false}
         ELSE {lo: (s.lo + s.hi) / 2, hi: s.hi, done: false} END,
    {lo: 1e-10::DOUBLE, hi: 1000.0::DOUBLE, done: false}) AS b FROM l),
f AS (SELECT e.id, other, rank, exp(-greatest(d - rho, 0) / ((b.lo + b.hi) / 2)) AS weight FROM e JOIN s ON e.id = s.id)"""


@query("emb02_neighbours", f"SELECT id, other, {R('d', 'd')}, rank::INT AS rank FROM ({knn('AND a.vec_id % 50 = 0')})")
def _(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(M.neighbours(v, v.where("id % 50 = 0"), 5))


@query("emb03_fuzzy_weights", f"WITH knn AS ({knn()}), {FUZZY} SELECT id, other, rank::INT AS rank, round(weight, 4) + 0.0 AS weight FROM f")
def _(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(M.fuzzy_weights(M.neighbours(v, v, 5), 5).select("id", "other", "rank", "weight"), 4)


@query("emb04_symmetrised", f"""WITH knn AS ({knn()}), {FUZZY},
u AS (SELECT id, other, weight, id AS i, rank AS r, 0 AS s FROM f UNION ALL SELECT other, id, weight, id, rank, 1 FROM f)
SELECT id, other, round(arg_min(weight, (i, r, s)), 4) + 0.0 AS weight FROM u GROUP BY 1, 2""")
def _(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(M.symmetrised(M.fuzzy_weights(M.neighbours(v, v, 5), 5)), 4)


@query("emb08_overlap", f"""WITH p AS ({knn()}), q AS ({knn('', CITY)})
SELECT round(avg(share), 6) AS overlap FROM (SELECT p.id, count(q.other) / 5.0::DOUBLE AS share FROM p LEFT JOIN q ON p.id = q.id AND p.other = q.other GROUP BY 1)""")
def _(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(M.overlap(M.neighbours(v, v, 5), M.neighbours(v, v, 5, "manhattan"), 5))
