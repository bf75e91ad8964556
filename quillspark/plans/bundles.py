"""Queries of feature vectors, similarities and images drawn from the strokes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import features as B
from quillspark.operators import pixels as I
from quillspark.plans.registry import query, rounded
from quillspark.plans.strokes import box, pts
from quillspark.schema import embedding_strokes

R = lambda e, a: f"round({e}, 6) + 0.0 AS {a}"
INK = "ink AS (SELECT DISTINCT stroke_id AS image_id, least(floor(y*32), 31)::INT AS y, least(floor(x*32), 31)::INT AS x FROM box)"
DRAWN = f"{INK}, img AS (SELECT vec_id AS image_id, gy::INT AS y, gx::INT AS x, floor(30 + 100 * (embedding[2*gy+1]::DOUBLE - embedding[2*gx+2]::DOUBLE + 2))::INT AS v FROM embeddings, range(32) a(gy), range(32) b(gx))"


def _gray(spark, sf_dir):
    """A gray image of each embedding: differences of its components."""
    e = embedding_strokes(spark, sf_dir).select(F.col("stroke_id").alias("image_id"), "points")
    rows = e.select("image_id", "points", F.posexplode("points").alias("y", "p"))
    rows = rows.select("image_id", "y", F.col("p.x").alias("a"), F.posexplode("points").alias("x", "q"))
    return rows.select("image_id", "y", "x", F.floor(30 + 100 * (F.col("a") - F.col("q.y") + 2)).cast("int").alias("v"))


LANDMARKS = """SELECT stroke_id, point, 'inflection' AS kind, 0.8::DOUBLE AS stability FROM (SELECT *, k+1 AS point, lag(c) OVER w AS pc, lead(c) OVER w AS nc FROM rob WINDOW w AS (PARTITION BY stroke_id ORDER BY k)) WHERE pc*nc < 0 OR (abs(c) < 0.01 AND abs(pc-nc) > 0.1)
  UNION ALL SELECT stroke_id, k+1, 'peak', 0.9::DOUBLE FROM (SELECT *, lag(c) OVER w AS pc, lead(c) OVER w AS nc FROM rob WINDOW w AS (PARTITION BY stroke_id ORDER BY k)) WHERE abs(c) > 0.01 AND c > pc AND c > nc
  UNION ALL SELECT stroke_id, e, 'endpoint', 1.0::DOUBLE FROM strokes, (VALUES (0), (31)) v(e)"""


@query("geo17_landmarks", f"SELECT stroke_id, point, kind, stability, {R('point/31.0::DOUBLE', 'along')} FROM ({LANDMARKS})", "strokes rob")
def _(spark, sf_dir):
    return rounded(B.landmarks(pts(spark, sf_dir)))


@query("geo18_stability_index", f"SELECT stroke_id, {R('avg(stability)', 'stability')}, count(*) AS n, 'endpoint' AS firmest FROM ({LANDMARKS}) GROUP BY 1", "strokes rob")
def _(spark, sf_dir):
    return rounded(B.stability_index(B.landmarks(pts(spark, sf_dir))))


@query("img02_stretched", f"WITH {DRAWN} SELECT image_id, y, x, CASE WHEN hi > lo THEN floor((v - lo)::DOUBLE / (hi - lo) * 255)::INT ELSE v END AS v FROM (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM img)", "box")
def _(spark, sf_dir):
    return I.stretched(_gray(spark, sf_dir))


@query("img03_otsu", f"WITH {DRAWN}, c AS (SELECT image_id, v, count(*)::DOUBLE AS n FROM img GROUP BY 1, 2), r AS (SELECT image_id, v, sum(n) OVER w AS n0, sum(n*v) OVER w AS s0, sum(n) OVER (PARTITION BY image_id) AS na, sum(n*v) OVER (PARTITION BY image_id) AS sa FROM c WINDOW w AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING)), b AS (SELECT image_id, v, round(n0*(na-n0)*(s0/n0 - (sa-s0)/(na-n0))*(s0/n0 - (sa-s0)/(na-n0)), 6) AS b FROM r WHERE na > n0) SELECT image_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY b DESC, v) AS k FROM b) WHERE k = 1", "box")
def _(spark, sf_dir):
    return I.otsu(_gray(spark, sf_dir))


@query("img10_pixel_links", f"WITH {INK} SELECT a.image_id, a.y AS y0, a.x AS x0, b.y, b.x FROM ink a JOIN ink b ON a.image_id = b.image_id AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x)", "box")
def _(spark, sf_dir):
    return I.links(I.rasterised(box(spark, sf_dir)))


@query("img09_special_pixels", f"WITH {INK} SELECT image_id, y, x, CASE WHEN n = 1 THEN 'end' ELSE 'junction' END AS kind FROM (SELECT a.image_id, a.y, a.x, count(*) AS n FROM ink a JOIN ink b ON a.image_id = b.image_id AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x) WHERE a.y BETWEEN 1 AND 30 AND a.x BETWEEN 1 AND 30 GROUP BY 1, 2, 3) WHERE n = 1 OR n >= 3", "box")
def _(spark, sf_dir):
    return I.special_pixels(I.rasterised(box(spark, sf_dir)), 32)


@query("img06_skeleton")
def _(spark, sf_dir):
    set_pixels = _gray(spark, sf_dir).where("v > 230").select("image_id", "y", "x")
    return I.skeleton(set_pixels, 32)


@query("img13_conversion_quality", f"WITH {INK}, k AS (SELECT image_id, count(*) AS pixels FROM ink GROUP BY 1) SELECT image_id, {R('0.4::DOUBLE*least(1, 32/pixels::DOUBLE) + 0.3::DOUBLE*least(1, 5/4.0::DOUBLE) + 0.3::DOUBLE*least(1, 8/20.0::DOUBLE)', 'quality')} FROM k", "box")
def _(spark, sf_dir):
    p = box(spark, sf_dir)
    strokes = p.select(F.col("stroke_id").alias("image_id"), F.floor(F.col("i") / 8).alias("path"))
    return rounded(I.conversion_quality(strokes, I.rasterised(p)))


@query("win34_stroke_timing")
def _(spark, sf_dir):
    p = box(spark, sf_dir).select(F.col("stroke_id").alias("image_id"), F.floor(F.col("i") / 8).alias("path"), (F.col("i") % 8).alias("i"), "x", "y")
    return rounded(I.stroke_timing(p))
