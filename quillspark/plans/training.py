"""Queries on training tables; each SQL form in a block of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import evaluation as E
from quillspark.operators import extra as O
from quillspark.operators import fitting as T
from quillspark.operators import training as N
from quillspark.operators.projection import projected
from quillspark.plans.registry import BODIES, query, rounded
from quillspark.schema import catalog_strokes, embedding_points, event_points, read


def unit(*keys: str) -> str:
    """The draw of the operators, from a digest of the keys."""
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)"


def normal(*keys: str) -> str:
    return f"(sqrt(-2 * ln({unit(*keys, chr(39) + 'r' + chr(39))})) * cos(2 * pi() * {unit(*keys, chr(39) + 'a' + chr(39))}))"


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("features"))


@query("ml03_feature_matrix", """WITH v AS (SELECT vec_id AS id, label::VARCHAR AS label, CASE WHEN vec_id % 3 = 0 THEN list_append(embedding, 1) ELSE embedding END AS f FROM embeddings WHERE label::VARCHAR IN ('1', '2', '5'))
SELECT id, label, list_transform(list_resize(list_transform(f, lambda x: x::DOUBLE), (SELECT max(len(f)) FROM v), 0), lambda x: round(x, 6) + 0.0) AS features FROM v""")
def _(spark, sf_dir):
    # whole vectors, some with one component more, so that the others are filled up
    uneven = _vectors(spark, sf_dir).withColumn("features", F.when(F.col("id") % 3 == 0, F.array_append("features", F.lit(1.0))).otherwise(F.col("features")))
    return rounded(N.feature_matrix(uneven, "features", ["1", "2", "5"]))


@query("ml06_fixed_sequences", """WITH t AS (SELECT *, CASE WHEN dt > 0 THEN ds / dt ELSE 0 END AS v, time - first_value(time) OVER (PARTITION BY stroke_id ORDER BY i) AS el FROM stp),
r AS (SELECT stroke_id, k, CASE WHEN i IS NULL THEN [0, 0, 0, 0, 0]::DOUBLE[] ELSE [round(x, 6) + 0.0, round(y, 6) + 0.0, 0, round(v, 6) + 0.0, round(el, 6) + 0.0] END AS row
      FROM (SELECT DISTINCT stroke_id AS stroke_id FROM t) s CROSS JOIN range(40) q(k) LEFT JOIN t USING (stroke_id) WHERE t.i = k OR (k >= 32 AND t.i = 0))
SELECT stroke_id, list(CASE WHEN k >= 32 THEN [0, 0, 0, 0, 0]::DOUBLE[] ELSE row END ORDER BY k) AS sequence FROM r GROUP BY 1""", "stp")
def _(spark, sf_dir):
    p = O.training_sequence(embedding_points(spark, sf_dir))
    six = lambda c: F.round(c, 6) + F.lit(0.0)
    return N.fixed_sequences(p.withColumns({c: six(F.col(c)) for c in ("x", "y", "velocity", "elapsed")}), 40)


@query("ml07_augmented_features", f"""WITH l AS (SELECT vec_id AS id, i::INT AS k, embedding[i+1]::DOUBLE AS x FROM embeddings, range(64) r(i)),
d AS (SELECT id, stddev_samp(x) AS sd, {unit("'augment'", 'id', "'noise?'")} < 0.3 AS noisy, {unit("'augment'", 'id', "'scale?'")} < 0.3 AS scaled, {unit("'augment'", 'id', "'scale'")} AS sc, {unit("'augment'", 'id', "'drop?'")} < 0.2 AS drops FROM l GROUP BY id)
SELECT id, k AS pos, round(CASE WHEN drops AND {unit("'augment'", 'id', "'drop'", 'k')} <= 0.1 THEN 0 ELSE (x + CASE WHEN noisy THEN 0.05 * sd ELSE 0 END * {normal("'augment'", 'id', 'k')})
       * CASE WHEN k < 10 AND scaled THEN 0.9 + 0.2 * sc ELSE 1 END END, 6) + 0.0 AS v FROM l JOIN d USING (id)""")
def _(spark, sf_dir):
    found = N.augmented_features(_vectors(spark, sf_dir).drop("label"))
    return rounded(found.select("id", F.posexplode("features").alias("pos", "v")))


@query("ml08_augmented_sequences", f"""WITH d AS (
  SELECT *, CASE WHEN {unit("'augment'", 'stroke_id', "'move?'")} < 0.4 THEN -20 + 40 * {unit("'augment'", 'stroke_id', "'x'")} ELSE 0 END AS mx, CASE WHEN {unit("'augment'", 'stroke_id', "'move?'")} < 0.4 THEN -20 + 40 * {unit("'augment'", 'stroke_id', "'y'")} ELSE 0 END AS my,
         CASE WHEN {unit("'augment'", 'stroke_id', "'scale?'")} < 0.4 THEN 0.8 + 0.4 * {unit("'augment'", 'stroke_id', "'scale'")} ELSE 1 END AS sc, CASE WHEN {unit("'augment'", 'stroke_id', "'turn?'")} < 0.3 THEN -0.2 + 0.4 * {unit("'augment'", 'stroke_id', "'angle'")} ELSE 0 END AS an,
         (time - 1704067200000) / 1000 + CASE WHEN {unit("'augment'", 'stroke_id', "'jitter?'")} < 0.3 THEN 0.01 * {normal("'augment'", 'stroke_id', 'i')} ELSE 0 END AS tj FROM evt)
SELECT stroke_id, i, round(cos(an) * (x + mx) * sc - sin(an) * (y + my) * sc, 6) + 0.0 AS x, round(sin(an) * (x + mx) * sc + cos(an) * (y + my) * sc, 6) + 0.0 AS y,
       round(max(tj) OVER (PARTITION BY stroke_id ORDER BY i ROWS UNBOUNDED PRECEDING), 5) + 0.0 AS time FROM d""", "evt")
def _(spark, sf_dir):
    seconds = event_points(spark, sf_dir).withColumn("time", (F.col("time") - 1704067200000) / 1000)
    found = N.augmented_sequences(seconds).withColumn("time", F.round("time", 5) + F.lit(0.0))
    return rounded(found.select("stroke_id", "i", "x", "y", "time"))


@query("jn20_train_rows", f"SELECT id, quality_score FROM cs JOIN (SELECT id FROM ({BODIES['ml01_stratified_split'][0]}) WHERE part = 'train') USING (id)", "cs")
def _(spark, sf_dir):
    rows = catalog_strokes(spark, sf_dir)
    return N.of_train_part(rows.select("id", "quality_score"), E.stratified_split(rows.select("id", "label")))


@query("ml09_batches", "SELECT id, (row_number() OVER (ORDER BY md5('batch:' || id), id) - 1) // 32 AS batch FROM cs", "cs")
def _(spark, sf_dir):
    return N.batches(catalog_strokes(spark, sf_dir).select("id"), 32)


@query("emb10_helix", """SELECT vec_id AS stroke_id, i::INT AS i, round(embedding[1]::DOUBLE + 0.1 * sin(2 * pi() * i / 99), 6) + 0.0 AS x, round(embedding[2]::DOUBLE + 0.1 * cos(2 * pi() * i / 99), 6) + 0.0 AS y,
       round(embedding[3]::DOUBLE + 0.2 * i / 99, 6) + 0.0 AS z, CASE WHEN label = 0 THEN 0.5 ELSE label::DOUBLE END AS weight FROM embeddings, range(100) r(i)""")
def _(spark, sf_dir):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    places = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stroke_id"), at(0).alias("px"), at(1).alias("py"), at(2).alias("pz"), F.col("label").cast("double").alias("stability"))
    return rounded(N.helix(places))


@query("emb12_mutual_information", """WITH l AS (SELECT label, i::INT AS pos, embedding[i+1]::DOUBLE AS v FROM embeddings, range(64) r(i)),
b AS (SELECT label, pos, CASE WHEN max(v) OVER p > min(v) OVER p THEN least(floor((v - min(v) OVER p) / (max(v) OVER p - min(v) OVER p) * 10), 9) ELSE 0 END AS bin FROM l WINDOW p AS (PARTITION BY pos)),
c AS (SELECT pos, label, bin, count(*) AS n FROM b GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER (PARTITION BY pos) AS t, sum(n) OVER (PARTITION BY pos, label) AS a, sum(n) OVER (PARTITION BY pos, bin) AS b FROM c)
SELECT pos, round(sum(n / t::DOUBLE * log2(n * t / (a * b)::DOUBLE)), 6) + 0.0 AS information FROM t GROUP BY 1""")
def _(spark, sf_dir):
    return rounded(N.mutual_information(_vectors(spark, sf_dir), "features", "label"))


@query("ml11_layers", """WITH s AS (SELECT max(len(embedding)) AS width, count(DISTINCT label) AS classes FROM embeddings),
l AS (SELECT 0 AS layer, width AS inputs, 32 AS outputs FROM s UNION ALL SELECT 1, 32, classes FROM s)
SELECT layer, inputs, outputs, (inputs + 1) * outputs AS parameters, round((inputs + 1) * outputs * 4 / 1048576.0::DOUBLE, 6) AS megabytes FROM l""")
def _(spark, sf_dir):
    return rounded(T.layers_of(_vectors(spark, sf_dir), "features", "label", (32,)))


def _split_vectors(spark, sf_dir):
    rows = E.standardised(_vectors(spark, sf_dir), "features").select("id", "label", F.col("scaled").alias("features"))
    return rows.join(E.stratified_split(rows.select("id", "label")).select("id", "part"), "id")


@query("ml12_training_history")
def _(spark, sf_dir):
    settings = T.Settings(hidden=(32,), epochs=8, steps=2, rate=0.01, patience=4)
    return rounded(T.fitted(_split_vectors(spark, sf_dir), settings=settings).history(spark))


@query("ml12_predictions")
def _(spark, sf_dir):
    rows = _split_vectors(spark, sf_dir)
    model = T.fitted(rows, settings=T.Settings(epochs=4, rate=0.05))
    return rounded(T.predicted(rows, model))


@query("emb11_projection")
def _(spark, sf_dir):
    return rounded(projected(_vectors(spark, sf_dir))[0])


@query("emb11_explained")
def _(spark, sf_dir):
    return rounded(projected(_vectors(spark, sf_dir))[1])
