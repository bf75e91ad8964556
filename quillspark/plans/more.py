"""Further queries: curves of scores, sequences for training, grids, generators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import embedding as M
from quillspark.operators import evaluation as E
from quillspark.operators import extra as O
from quillspark.operators import homology as H
from quillspark.operators import layout as L
from quillspark.operators import sequence as S
from quillspark.operators import spectral as X
from quillspark.operators import topology as T
from quillspark.operators.geometry import joint_square
from quillspark.plans.registry import query, rounded
from quillspark.plans.strokes import box, pts
from quillspark.schema import catalog_strokes, event_points, predictions, read

R = lambda e, a: f"round({e}, 6) + 0.0 AS {a}"


@query("emb01_distances", f"WITH v AS (SELECT vec_id, embedding AS a, lag(embedding) OVER (ORDER BY vec_id) AS b FROM embeddings), l AS (SELECT vec_id, a[j]::DOUBLE AS x, b[j]::DOUBLE AS y FROM v, range(1, 65) r(j) WHERE b IS NOT NULL) SELECT vec_id, {R('sqrt(sum((x-y)*(x-y)))', 'euclidean')}, {R('sum(abs(x-y))', 'manhattan')}, {R('1 - sum(x*y)/(sqrt(sum(x*x))*sqrt(sum(y*y)))', 'cosine')} FROM l GROUP BY 1")
def _(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    pairs = v.join(v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return rounded(pairs.select("vec_id", *(M.distance(F.col("a"), F.col("b"), k).alias(k) for k in ("euclidean", "manhattan", "cosine"))))


@query("emb05_initial_places", """WITH RECURSIVE n AS (SELECT count(*) AS n FROM embeddings), g(k, x) AS (SELECT 0, 42::BIGINT UNION ALL SELECT k + 1, (x * 9301 + 49297) % 233280 FROM g, n WHERE k < 3 * n), v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings)
  SELECT vec_id, j::INT AS axis, round((x / 233280.0::DOUBLE - 0.5) * 20, 6) + 0.0 AS place FROM v, range(3) q(j), g WHERE g.k = 3 * r + j + 1""")
def _(spark, sf_dir):
    rows = O.ranked_by_id(read(spark, sf_dir, "embeddings").select("vec_id"), "vec_id").withColumnRenamed("place", "r")
    places = rows.select("vec_id", "r", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("axis"))
    return rounded(places.select("vec_id", "axis", O.initial_place(3 * F.col("r") + F.col("axis") + 1).alias("place")))


@query("emb06_layout")
def _(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    graph = M.symmetrised(M.fuzzy_weights(M.neighbours(v, v, 15), 15))
    places = O.ranked_by_id(v.select("id"), "id").withColumnRenamed("place", "number")
    places = places.withColumn("place", F.array(*(O.initial_place(3 * F.col("number") + a + 1) for a in range(3))))
    return rounded(L.laid_out(graph, places, epochs=20).select(F.col("id").alias("vec_id"), "place"))


@query("emb07_stress", """WITH p AS (
  SELECT sqrt(list_sum(list_transform(range(1, 65), lambda j: pow(a.embedding[j]::DOUBLE - b.embedding[j]::DOUBLE, 2)))) AS d,
         sqrt(list_sum(list_transform(range(1, 4), lambda j: pow(a.embedding[j]::DOUBLE - b.embedding[j]::DOUBLE, 2)))) AS e
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT round(sqrt(sum(pow(d - e, 2)) / sum(d * d)), 6) AS stress FROM p""")
def _(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(M.stress(v.withColumn("e", F.slice("v", 1, 3))))


@query("ev07_roc_curve", f"SELECT class, {R('s', 's')}, {R('sum(y) OVER w / sum(y) OVER (PARTITION BY class)', 'tpr')}, {R('sum(1-y) OVER w / sum(1-y) OVER (PARTITION BY class)', 'fpr')} FROM (SELECT k::INT AS class, round(p[k + 1], 9) AS s, (target = k)::INT AS y FROM pr, range(10) q(k)) WINDOW w AS (PARTITION BY class ORDER BY s DESC)", "pr")
def _(spark, sf_dir):
    return rounded(O.roc_curves(predictions(spark, sf_dir))).select("class", "s", "tpr", "fpr")


@query("ev11_softmax", f"SELECT vec_id, i::INT AS pos, {R('exp(e) / sum(exp(e)) OVER (PARTITION BY vec_id)', 'p')} FROM (SELECT vec_id, i, embedding[i+1]::DOUBLE AS e FROM embeddings, range(64) r(i))")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return rounded(e.select("vec_id", F.posexplode(E.softmax(F.col("e"))).alias("pos", "p")))


@query("win33_training_sequence", f"SELECT stroke_id, i, {R('CASE WHEN dt > 0 THEN ds/dt ELSE 0 END', 'velocity')}, {R('time - t0', 'elapsed')} FROM (SELECT *, first_value(time) OVER (PARTITION BY stroke_id ORDER BY i) AS t0 FROM stp)", "stp", "evt")
def _(spark, sf_dir):
    return rounded(O.training_sequence(event_points(spark, sf_dir)).select("stroke_id", "i", "velocity", "elapsed"))


@query("ml02_random_split", "SELECT id, CASE WHEN rn <= floor(n * (1 - 0.2::DOUBLE - 0.1::DOUBLE)) THEN 'train' WHEN rn <= floor(n * (1 - 0.2::DOUBLE - 0.1::DOUBLE)) + floor(n * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END AS part FROM (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS rn, count(*) OVER () AS n FROM cs)", "cs")
def _(spark, sf_dir):
    return O.random_split(catalog_strokes(spark, sf_dir).select("id"))


@query("spc02_short_spectrum", f"SELECT stroke_id, f::INT AS k, {R('sqrt(pow(sum(v*cos(-2*pi()*f*k/32)),2) + pow(sum(v*sin(-2*pi()*f*k/32)),2))/32', 'magnitude')} FROM sig, range(16) q(f) GROUP BY 1, 2", "sig")
def _(spark, sf_dir):
    return rounded(X.short_spectrum(X.tangent_signal(pts(spark, sf_dir))).select("stroke_id", "k", "magnitude"))


@query("spc06_flux", f"SELECT stroke_id, {R('sum(greatest(0, power - lp))', 'flux')} FROM (SELECT *, lag(power) OVER (PARTITION BY k ORDER BY stroke_id) AS lp FROM psd) WHERE lp IS NOT NULL GROUP BY 1", "psd")
def _(spark, sf_dir):
    spectra = X.spectrum(X.tangent_signal(pts(spark, sf_dir)))
    pairs = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stroke_id"), (F.col("vec_id") - 1).alias("other"))
    return rounded(O.flux(spectra, pairs))


@query("win24_normalised_affine_arc", f"WITH a AS (SELECT stroke_id, i, sum(coalesce(pow(abs((pdx/m)*((dy-pdy)/(m*m)) - ((dx-pdx)/(m*m))*(pdy/m)), 1/3.0::DOUBLE)*m, 0)) OVER (PARTITION BY stroke_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(dx) OVER w AS pdx, lag(dy) OVER w AS pdy, (greatest(dt,1) + greatest(lag(dt) OVER w,1))/2 AS m FROM stp WINDOW w AS (PARTITION BY stroke_id ORDER BY i))) SELECT stroke_id, i, {R('CASE WHEN max(s) OVER (PARTITION BY stroke_id) = 0 THEN 0 ELSE s / max(s) OVER (PARTITION BY stroke_id) END', 'sigma')} FROM a", "stp")
def _(spark, sf_dir):
    return rounded(O.normalised_arc(S.affine_arc(pts(spark, sf_dir))).select("stroke_id", "i", "sigma"))


@query("jn17_density_grid", "SELECT stroke_id, gx::INT AS gx, gy::INT AS gy, count(*) AS n FROM box, range(0, 5) a(gx), range(0, 5) b(gy) WHERE abs(x*4 - gx) < 1 AND abs(y*4 - gy) < 1 GROUP BY 1, 2, 3 HAVING count(*) > 1", "box")
def _(spark, sf_dir):
    return O.density_grid(box(spark, sf_dir), 4)


@query("jn17_density_cloud", """WITH p AS (SELECT stroke_id, x * 10 AS x, y * 10 AS y, i::DOUBLE AS z FROM box),
b AS (SELECT stroke_id, count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM p GROUP BY 1),
c AS (SELECT stroke_id, k, l, m, count(*) AS here, any_value(n) AS n, any_value(lx) AS lx, any_value(ly) AS ly, any_value(lz) AS lz FROM p JOIN b USING (stroke_id), range(0, 6) a(k), range(0, 6) e(l), range(0, 17) d(m)
  WHERE abs(x - (lx + k * 2)) < 2 AND abs(y - (ly + l * 2)) < 2 AND abs(z - (lz + m * 2)) < 2 AND lx + k * 2 <= hx AND ly + l * 2 <= hy AND lz + m * 2 <= hz GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)
SELECT stroke_id, round(lx + k * 2, 6) + 0.0 AS gx, round(ly + l * 2, 6) + 0.0 AS gy, round(lz + m * 2, 6) + 0.0 AS gz, round(here / n::DOUBLE, 6) + 0.0 AS density
FROM (SELECT *, row_number() OVER (PARTITION BY stroke_id ORDER BY k, l, m) AS place FROM c) WHERE place <= 100""", "box")
def _(spark, sf_dir):
    wide = box(spark, sf_dir).withColumns({"x": F.col("x") * 10, "y": F.col("y") * 10, "z": F.col("i").cast("double")})
    return rounded(O.density_cloud(wide))


@query("geo02_joint_square", f"SELECT stroke_id, i, {R('(x - min(x) OVER d) / (max(x) OVER d - min(x) OVER d)', 'x')}, {R('(y - min(y) OVER d) / (max(y) OVER d - min(y) OVER d)', 'y')} FROM pts WINDOW d AS (PARTITION BY label)", "pts")
def _(spark, sf_dir):
    return rounded(joint_square(pts(spark, sf_dir), "label").select("stroke_id", "i", "x", "y"))


@query("agg12_run_times", f"SELECT user_id, {R('avg(value)', 'mean')}, {R('list_sort(list(value))[count(*)//2 + 1]', 'median')}, {R('avg((value <= 100)::INT)', 'on_time')} FROM events GROUP BY 1")
def _(spark, sf_dir):
    return rounded(O.run_times(read(spark, sf_dir, "events"), "user_id", "value", 100.0))


@query("geo28_quarter_points", "SELECT stroke_id, i, round(0.7::DOUBLE - 0.1::DOUBLE * q, 6) AS stability FROM evt JOIN (SELECT stroke_id AS s, count(*) AS n FROM evt GROUP BY 1) ON s = stroke_id, range(1, 4) r(q) WHERE i = floor(n * q / 4.0::DOUBLE)", "evt")
def _(spark, sf_dir):
    return rounded(O.quarter_points(event_points(spark, sf_dir)).drop("q"))


@query("str04_rolling_mean", f"SELECT event_id, {R('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 'recent')} FROM events")
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return rounded(read(spark, sf_dir, "events").select("event_id", F.avg("value").over(w).alias("recent")))


@query("topo_persistence_summary")
def _(spark, sf_dir):
    return rounded(T.persistence_summary(H.intervals(box(spark, sf_dir))))
