"""Queries on whole analyses, signatures along the path, homology in both dimensions; each SQL form in a block of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import analysis as A
from quillspark.operators import features as W
from quillspark.operators import homology as H
from quillspark.operators import sequence as S
from quillspark.operators import signature as Z
from quillspark.plans import bundles, more  # noqa: F401 - their SQL forms are used here
from quillspark.plans.registry import over, query, rounded
from quillspark.plans.strokes import box, pts
from quillspark.schema import embedding_points, event_points

AFFINE = """
arc AS (
  SELECT stroke_id, i, x, y, sum(coalesce(pow(abs((pdx / m) * ((dy - pdy) / (m * m)) - ((dx - pdx) / (m * m)) * (pdy / m)), 1 / 3.0::DOUBLE) * m, 0))
         OVER (PARTITION BY stroke_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, lag(dx) OVER w AS pdx, lag(dy) OVER w AS pdy, (greatest(dt, 1) + greatest(lag(dt) OVER w, 1)) / 2 AS m
        FROM stp WINDOW w AS (PARTITION BY stroke_id ORDER BY i))),
kap AS (
  SELECT stroke_id, i, CASE WHEN top = 0 THEN 0 ELSE s / top END AS sigma,
         CASE WHEN ns - ps < 1e-10 OR s - ps < 1e-10 OR ns - s < 1e-10 THEN 0 ELSE
           ((nx - x) / (ns - s) - (x - px) / (s - ps)) / ((ns - ps) / 2) * ((ny - py) / (ns - ps))
           - ((ny - y) / (ns - s) - (y - py) / (s - ps)) / ((ns - ps) / 2) * ((nx - px) / (ns - ps)) END AS kappa
  FROM (SELECT *, lag(s) OVER w AS ps, lead(s) OVER w AS ns, lag(x) OVER w AS px, lead(x) OVER w AS nx, lag(y) OVER w AS py, lead(y) OVER w AS ny,
               count(*) OVER (PARTITION BY stroke_id) AS n, max(s) OVER (PARTITION BY stroke_id) AS top
        FROM arc WINDOW w AS (PARTITION BY stroke_id ORDER BY i))
  WHERE i >= 2 AND i < n - 2)"""


def tame(name: str) -> str:
    """Large values brought into (-1, 1), so that all places of a rounding count."""
    return f"{name} / (1 + abs({name}))"


@query("win26_affine_signature", f"WITH {AFFINE} SELECT stroke_id, i, round(sigma, 6) AS sigma, round({tame('kappa')}, 6) + 0.0 AS kappa FROM kap", "stp")
def _(spark, sf_dir):
    found = S.affine_signature(pts(spark, sf_dir))
    return rounded(found.withColumn("kappa", F.expr(tame("kappa"))))


@query("geo25_affine_similarity", f"""WITH {AFFINE},
lists AS (SELECT stroke_id, list(kappa ORDER BY i) AS k, count(*) AS n FROM kap GROUP BY 1),
pair AS (SELECT a.stroke_id, b.stroke_id AS other, a.k AS ka, b.k AS kb, a.n AS na, b.n AS nb, least(a.n, b.n, 50) AS m FROM lists a JOIN lists b ON b.stroke_id = a.stroke_id - 1),
steps AS (SELECT *, CASE WHEN m > 1 THEN j / (m - 1)::DOUBLE ELSE 0 END AS t FROM pair, range(50) r(j) WHERE j < m),
placed AS (SELECT *, floor(t * (na - 1))::BIGINT AS ia, floor(t * (nb - 1))::BIGINT AS ib FROM steps),
vals AS (SELECT stroke_id, other, ka[ia+1] + (t * (na - 1) - ia) * (ka[least(ia + 1, na - 1) + 1] - ka[ia+1]) AS a,
                kb[ib+1] + (t * (nb - 1) - ib) * (kb[least(ib + 1, nb - 1) + 1] - kb[ib+1]) AS b FROM placed)
SELECT stroke_id, other, round(CASE WHEN sum(a*a) * sum(b*b) > 0 THEN abs(sum(a*b) / sqrt(sum(a*a) * sum(b*b))) ELSE 0 END, 6) AS similarity FROM vals GROUP BY 1, 2""", "stp")
def _(spark, sf_dir):
    found = S.affine_signature(pts(spark, sf_dir))
    series = found.groupBy("stroke_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "kappa"))), lambda s: s["kappa"]).alias("k"))
    pairs = series.select("stroke_id", (F.col("stroke_id") - 1).alias("other"))
    both = W.paired(series, pairs)
    return rounded(both.select("stroke_id", "other", W.series_similarity(F.col("k"), F.col("o_k")).alias("similarity")))


@query("win28_curvature_signature", """WITH l AS (SELECT stroke_id, i, sum(coalesce(ds, 0)) OVER (PARTITION BY stroke_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS arc, sum(ds) OVER (PARTITION BY stroke_id) AS total FROM stp)
SELECT stroke_id, i, round(CASE WHEN total > 0 THEN arc / total ELSE 0 END, 6) AS s, round(CASE WHEN total > 0 THEN c * total ELSE c END, 6) + 0.0 AS kappa
FROM rob JOIN l USING (stroke_id, i)""", "stp rob")
def _(spark, sf_dir):
    return rounded(S.curvature_signature(pts(spark, sf_dir)))


@query("win16_peaks_and_valleys", """SELECT stroke_id, string_agg(sx, '' ORDER BY i) AS x_sequence, string_agg(sy, '' ORDER BY i) AS y_sequence
FROM (SELECT stroke_id, i, CASE WHEN x > px AND x > nx THEN 'P' WHEN x < px AND x < nx THEN 'V' ELSE '-' END AS sx, CASE WHEN y > py AND y > ny THEN 'P' WHEN y < py AND y < ny THEN 'V' ELSE '-' END AS sy
      FROM (SELECT *, lag(x) OVER w AS px, lead(x) OVER w AS nx, lag(y) OVER w AS py, lead(y) OVER w AS ny FROM box WINDOW w AS (PARTITION BY stroke_id ORDER BY i))
      WHERE px IS NOT NULL AND nx IS NOT NULL) GROUP BY 1""", "box")
def _(spark, sf_dir):
    return S.peaks_and_valleys(box(spark, sf_dir))


@query("win36_spline_controls", """SELECT stroke_id, i, round(x + (x2 - x0) * 0.5 / 6, 6) + 0.0 AS c1x, round(y + (y2 - y0) * 0.5 / 6, 6) + 0.0 AS c1y,
       round(x2 - (x3 - x) * 0.5 / 6, 6) + 0.0 AS c2x, round(y2 - (y3 - y) * 0.5 / 6, 6) + 0.0 AS c2y, round(x2, 6) + 0.0 AS x2, round(y2, 6) + 0.0 AS y2
FROM (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(x, 2) OVER w AS x3, lead(y, 2) OVER w AS y3 FROM pts WINDOW w AS (PARTITION BY stroke_id ORDER BY i))
WHERE x0 IS NOT NULL AND x3 IS NOT NULL""", "pts")
def _(spark, sf_dir):
    return rounded(S.spline_controls(pts(spark, sf_dir)))


@query("win32_never_back", "SELECT stroke_id, i, round(max(y) OVER (PARTITION BY stroke_id ORDER BY i ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS y FROM evt", "evt")
def _(spark, sf_dir):
    return rounded(S.never_back(event_points(spark, sf_dir), "y").select("stroke_id", "i", "y"))


@query("win29_processed", """WITH p AS (
  SELECT *, lead(dx) OVER w AS ndx, lead(dy) OVER w AS ndy, lead(ds) OVER w AS nds, ds / greatest(dt, 1) AS v,
         sum(coalesce(ds, 0)) OVER (PARTITION BY stroke_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS arc, sum(ds) OVER (PARTITION BY stroke_id) AS total
  FROM stp WINDOW w AS (PARTITION BY stroke_id ORDER BY i)),
q AS (SELECT *, CASE WHEN ds * nds > 0 THEN (dx * ndy - dy * ndx) / (ds * nds) WHEN ds * nds = 0 THEN 0 END AS c, (v - lag(v) OVER w) / greatest(dt, 1) AS a FROM p WINDOW w AS (PARTITION BY stroke_id ORDER BY i))
SELECT stroke_id, i, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(time, 6) + 0.0 AS time, round(CASE WHEN total > 0 THEN arc / total ELSE 0 END, 6) AS "s_L", round(CASE WHEN total > 0 THEN coalesce(c * total, 0) ELSE 0 END, 6) + 0.0 AS "kappa_L",
       round(coalesce(v, 0), 6) AS velocity, round(coalesce(a, 0), 6) + 0.0 AS acceleration, round(coalesce(CASE WHEN ds IS NOT NULL THEN atan2(dy, dx) END, 0), 6) + 0.0 AS tangent
FROM q""", "stp")
def _(spark, sf_dir):
    return rounded(S.processed(pts(spark, sf_dir)))


ANALYSIS = f"""
SELECT n.stroke_id, n.n, false AS crowded, c.complexity, c.regularity, st.stability AS stability_index, st.n AS n_landmarks, sy.symmetry, round(af.affine_length, 6) AS affine_length,
       w.writhe, tw.origin_winding AS winding, tw.total_turning, k.n_crossings, m.centroid, sg.s_x, sg.s_y, sg.s_xy, sg.s_yx, sg.variation
FROM (SELECT stroke_id, count(*) AS n FROM pts GROUP BY 1) n
JOIN {over('win39_curvature_metrics', 'box')} c USING (stroke_id)
JOIN {over('geo18_stability_index', 'box')} st USING (stroke_id)
JOIN {over('geo08_symmetry', 'box')} sy USING (stroke_id)
JOIN (SELECT stroke_id, max(s) AS affine_length FROM arc GROUP BY 1) af USING (stroke_id)
JOIN {over('geo21_writhe', 'box')} w USING (stroke_id)
JOIN {over('win19_turning_and_windings', 'box')} tw USING (stroke_id)
JOIN {over('geo23_knot_features', 'box')} k USING (stroke_id)
JOIN {over('spc04_moments', 'box')} m USING (stroke_id)
JOIN {over('sig_levels', 'box')} sg USING (stroke_id)"""
SHOWN = "stroke_id n crowded complexity regularity stability_index n_landmarks symmetry affine_length writhe winding total_turning n_crossings centroid s_x s_y s_xy s_yx variation".split()


@query("geo34_analysis", f"WITH {AFFINE} {ANALYSIS}", "stp", "box")
def _(spark, sf_dir):
    found = A.analyse(embedding_points(spark, sf_dir))
    at = lambda c, k: F.get(c, F.lit(k))
    found = found.withColumns({"s_x": at("level1", 0), "s_y": at("level1", 1), "s_xy": at("level2", 1), "s_yx": at("level2", 2)})
    return rounded(found.select(*SHOWN))


@query("geo31_drawing_analysis", f"""SELECT count(*) AS n_strokes, sum(n)::BIGINT AS n_points, round(avg(complexity), 4) AS complexity, round(avg(regularity), 4) AS regularity, round(avg(symmetry), 4) AS symmetry
FROM (SELECT stroke_id, count(*) AS n FROM pts GROUP BY 1) JOIN {over('win39_curvature_metrics', 'box')} USING (stroke_id) JOIN {over('geo08_symmetry', 'box')} USING (stroke_id)""", "pts")
def _(spark, sf_dir):
    return rounded(A.of_drawing(A.analyse(embedding_points(spark, sf_dir), ("preprocessing", "curvature"))), 4)


@query("geo33_quality", "SELECT stroke_id, round(0.4 * CASE WHEN t <= 100 THEN 1 ELSE greatest(0, 1 - (t - 100) / 100) END + 0.4 * 5 / 7.0::DOUBLE + 0.2 * least(1, n / 100.0::DOUBLE), 6) AS quality FROM (SELECT stroke_id, count(*) AS n, avg(y) AS t FROM evt GROUP BY 1)", "evt")
def _(spark, sf_dir):
    per = event_points(spark, sf_dir).groupBy("stroke_id").agg(F.count("*").alias("n"), F.avg("y").alias("t"))
    return rounded(per.select("stroke_id", A.quality(F.col("t"), F.col("n"), F.lit(5)).alias("quality")))


@query("geo07_thinned", """WITH b AS (
  SELECT stroke_id, i, (x - min(x) OVER s) / CASE WHEN max(x) OVER s = min(x) OVER s THEN 1 ELSE max(x) OVER s - min(x) OVER s END AS x,
         (y - min(y) OVER s) / CASE WHEN max(y) OVER s = min(y) OVER s THEN 1 ELSE max(y) OVER s - min(y) OVER s END AS y, ceil(count(*) OVER s / 40.0::DOUBLE)::INT AS step
  FROM evt WINDOW s AS (PARTITION BY stroke_id))
SELECT stroke_id, (i // step)::INT AS i, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM b WHERE i % step = 0""", "evt")
def _(spark, sf_dir):
    return rounded(A.thinned(event_points(spark, sf_dir), 40).select("stroke_id", "i", "x", "y"))


@query("emb09_comprehensive_features")
def _(spark, sf_dir):
    return rounded(A.comprehensive(A.analyse(embedding_points(spark, sf_dir))), 5)


@query("topo03_loops")
def _(spark, sf_dir):
    return rounded(H.loop_intervals(box(spark, sf_dir)))


@query("topo04_betti_numbers")
def _(spark, sf_dir):
    return H.betti_numbers(H.intervals(box(spark, sf_dir)))


@query("topo09_features")
def _(spark, sf_dir):
    return rounded(H.features(H.metrics(box(spark, sf_dir))))


@query("sig09_path_signature", "SELECT stroke_id, [s_x, s_y] AS level1, [s_xx, s_xy, s_yx, s_yy] AS level2, variation FROM sig_levels_of".replace("sig_levels_of", over("sig_levels", "pts")))
def _(spark, sf_dir):
    return rounded(Z.path_signature(pts(spark, sf_dir)).select("stroke_id", "level1", "level2", "variation"))
