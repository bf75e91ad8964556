"""Queries of the checks, triangulations, path labels and the batch forms of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import triangulation as A
from quillspark.operators import validation as V
from quillspark.operators.features import paired
from quillspark.plans.registry import over, query, rounded
from quillspark.plans.strokes import box, pts
from quillspark.schema import catalog_strokes, embedding_strokes, event_points, read
from quillspark.sources.files import label_of_path, sample_files
from quillspark.streaming.strokes import strokes_by_pause, windowed_counts

R = lambda e, a: f"round({e}, 6) + 0.0 AS {a}"


@query("val02_check_strokes", "SELECT stroke_id, count(*) AS n_points, (count(*) FILTER (time < lt) + CASE WHEN count(*) < 2 OR count(*) > 60 THEN 1 ELSE 0 END)::BIGINT AS n_errors, (count(*) FILTER (time = lt) + count(*) FILTER (abs(x) > 10000 OR abs(y) > 10000) + count(*) FILTER (time < 0) + count(*) FILTER (pressure < 0 OR pressure > 1))::BIGINT AS n_warnings, NOT (count(*) FILTER (time < lt) > 0 OR count(*) < 2 OR count(*) > 60) AS is_valid FROM (SELECT *, lag(time) OVER (PARTITION BY stroke_id ORDER BY i) AS lt FROM evt) GROUP BY 1", "evt")
def _(spark, sf_dir):
    return V.check_strokes(event_points(spark, sf_dir), most=60)


@query("agg07_imbalance", "SELECT label, n, CASE WHEN n < 5 THEN 'few' WHEN n * 3 < max(n) OVER () THEN 'imbalanced' ELSE 'none' END AS warning FROM (SELECT label, count(*) AS n FROM cs GROUP BY 1)", "cs")
def _(spark, sf_dir):
    return V.imbalance(catalog_strokes(spark, sf_dir))


@query("win31_repaired_times", "WITH t AS (SELECT vec_id, list_transform(embedding, lambda v: floor(v::DOUBLE * 40)) AS ts FROM embeddings) SELECT vec_id, r[64] AS last_time, list_sum(r) AS total FROM (SELECT vec_id, list_reduce(ts[2:], lambda a, t: list_append(a, CASE WHEN t <= a[-1] THEN a[-1] + 1 ELSE t END), [ts[1]]) AS r FROM t)")
def _(spark, sf_dir):
    times = F.transform("embedding", lambda v: F.floor(v.cast("double") * 40).cast("double"))
    out = read(spark, sf_dir, "embeddings").select("vec_id", V.repaired_times(times).alias("r"))
    return out.select("vec_id", F.element_at("r", -1).alias("last_time"), F.aggregate("r", F.lit(0.0), lambda s, v: s + v).alias("total"))


@query("val04_normalised", "SELECT stroke_id, i, CASE WHEN i % 7 = 0 THEN 0 ELSE round(x, 6) END + 0.0 AS x, CASE WHEN i % 5 = 0 THEN 0 ELSE round(coalesce(y, 0), 6) END + 0.0 AS y, round(greatest(0, least(1, pressure * 2 - 0.5)), 6) AS pressure FROM evt", "evt")
def _(spark, sf_dir):
    broken = {"x": F.when(F.col("i") % 7 != 0, F.col("x")), "y": F.when(F.col("i") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("y")), "pressure": F.col("pressure") * 2 - 0.5}
    return rounded(V.normalised(event_points(spark, sf_dir).withColumns(broken)).select("stroke_id", "i", "x", "y", "pressure"))


@query("val06_report", """SELECT stroke_id, 'points ' || n_points || CASE WHEN n_errors > 0 THEN '; errors ' || n_errors ELSE '' END || CASE WHEN n_warnings > 0 THEN '; warnings ' || n_warnings ELSE '' END AS report
FROM checked""".replace("checked", over("val02_check_strokes", "evt")))
def _(spark, sf_dir):
    shifted = event_points(spark, sf_dir)
    return V.report(V.check_strokes(shifted, most=60))


TRIANGLES = """t0 AS (SELECT a.stroke_id, a.i AS a, b.i AS b, c.i AS c, a.x xa, a.y ya, b.x xb, b.y yb, c.x xc, c.y yc, abs((b.x-a.x)*(c.y-a.y) - (c.x-a.x)*(b.y-a.y))/2 AS area, 2*(a.x*(b.y-c.y) + b.x*(c.y-a.y) + c.x*(a.y-b.y)) AS den FROM box a JOIN box b ON a.stroke_id = b.stroke_id AND a.i < b.i JOIN box c ON a.stroke_id = c.stroke_id AND b.i < c.i),
  t1 AS (SELECT *, ((xa*xa+ya*ya)*(yb-yc) + (xb*xb+yb*yb)*(yc-ya) + (xc*xc+yc*yc)*(ya-yb))/den AS cx, ((xa*xa+ya*ya)*(xc-xb) + (xb*xb+yb*yb)*(xa-xc) + (xc*xc+yc*yc)*(xb-xa))/den AS cy FROM t0 WHERE area > 1e-10),
  t2 AS (SELECT *, sqrt((cx-xa)*(cx-xa)+(cy-ya)*(cy-ya)) AS r FROM t1),
  tri AS (SELECT * FROM t2 WHERE NOT EXISTS (SELECT 1 FROM box o WHERE o.stroke_id = t2.stroke_id AND o.i NOT IN (t2.a, t2.b, t2.c) AND sqrt((o.x-t2.cx)*(o.x-t2.cx)+(o.y-t2.cy)*(o.y-t2.cy)) < t2.r - 1e-10))"""


@query("alf02_triangles", f"WITH {TRIANGLES} SELECT stroke_id, a, b, c, {R('r', 'r')} FROM tri", "box")
def _(spark, sf_dir):
    return rounded(A.triangles(box(spark, sf_dir)).select("stroke_id", "a", "b", "c", "r"))


@query("alf04_shape", f"WITH {TRIANGLES}, k AS (SELECT * FROM tri WHERE r <= 0.4), e AS (SELECT stroke_id, u, v, count(*) AS n, any_value(l) AS l FROM (SELECT stroke_id, a AS u, b AS v, sqrt((xa-xb)*(xa-xb)+(ya-yb)*(ya-yb)) AS l FROM k UNION ALL SELECT stroke_id, b, c, sqrt((xc-xb)*(xc-xb)+(yc-yb)*(yc-yb)) FROM k UNION ALL SELECT stroke_id, a, c, sqrt((xa-xc)*(xa-xc)+(ya-yc)*(ya-yc)) FROM k) GROUP BY 1, 2, 3), b AS (SELECT stroke_id, count(*) AS n_border, sum(l) AS perimeter FROM e WHERE n = 1 GROUP BY 1), s AS (SELECT stroke_id, count(*) AS n_triangles, sum(area) AS area FROM k GROUP BY 1) SELECT stroke_id, n_triangles, {R('area', 'area')}, n_border, {R('perimeter', 'perimeter')} FROM s LEFT JOIN b USING (stroke_id)", "box")
def _(spark, sf_dir):
    return rounded(A.shape(A.triangles(box(spark, sf_dir)), 0.4))


@query("alf06_critical_alpha", f"""WITH {TRIANGLES},
sides AS (
  SELECT stroke_id, a AS u, b AS v, r, sqrt((xa-xb)*(xa-xb) + (ya-yb)*(ya-yb)) AS l FROM tri
  UNION ALL SELECT stroke_id, b, c, r, sqrt((xb-xc)*(xb-xc) + (yb-yc)*(yb-yc)) FROM tri
  UNION ALL SELECT stroke_id, a, c, r, sqrt((xa-xc)*(xa-xc) + (ya-yc)*(ya-yc)) FROM tri),
vals AS (SELECT stroke_id, r AS v FROM tri UNION SELECT stroke_id, min(least(r, l / 2)) FROM sides GROUP BY stroke_id, u, v)
SELECT stroke_id, round(w[len(w) // 2 + 1], 6) AS alpha FROM (SELECT stroke_id, list_sort(list(v)) AS w FROM vals GROUP BY 1)""", "box")
def _(spark, sf_dir):
    return rounded(A.critical_alpha(A.triangles(box(spark, sf_dir))))


@query("alf08_shape_features")
def _(spark, sf_dir):
    return rounded(A.shape_features(box(spark, sf_dir), 0.2))


@query("alf08_shape_similarity")
def _(spark, sf_dir):
    found = A.shape_features(box(spark, sf_dir), 0.2)
    both = paired(found, found.select("stroke_id", (F.col("stroke_id") - 1).alias("other")))
    return rounded(both.select("stroke_id", "other", A.shape_similarity(F.col("features"), F.col("o_features")).alias("similarity")))


@query("alf07_polygon_area", f"SELECT stroke_id, {R('abs(sum(x*ny - nx*y))/2', 'area')} FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM pts WINDOW w AS (PARTITION BY stroke_id ORDER BY i)) GROUP BY 1", "pts")
def _(spark, sf_dir):
    return rounded(A.polygon_area(pts(spark, sf_dir)))


@query("src08_label_of_path", "SELECT page_id, CASE WHEN regexp_matches(f, '^[A-Za-z0-9]$') THEN upper(f) WHEN regexp_extract(n, '[A-Za-z0-9]', 0) <> '' THEN upper(regexp_extract(n, '[A-Za-z0-9]', 0)) ELSE 'UNKNOWN' END AS label FROM (SELECT page_id, regexp_extract(url, '([^/]*)/[^/]*$', 1) AS f, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS n FROM pages)")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", label_of_path(F.col("url")).alias("label"))


@query("src06_sample_files", "SELECT url AS path FROM pages ORDER BY md5('42:' || url), url LIMIT 20")
def _(spark, sf_dir):
    return sample_files(read(spark, sf_dir, "pages").select(F.col("url").alias("path")), 20)


@query("str05_strokes_by_pause", f"SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n, {R('sum(value)', 'total')} FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, g")
def _(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = strokes_by_pause(events, "6 hours")
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}))


@query("str_windowed_counts", f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, {R('sum(value)', 'total')} FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(windowed_counts(events).withColumn("start", F.col("start").cast("timestamp_ntz")))


@query("gather_strokes", "SELECT vec_id AS stroke_id, label::VARCHAR AS label, list_transform(range(32), lambda k: round(embedding[2*k+1]::DOUBLE, 6) + 0.0) AS xs, list_transform(range(32), lambda k: round(embedding[2*k+2]::DOUBLE, 6) + 0.0) AS ys, list_transform(range(32), lambda k: 10.0::DOUBLE * k) AS times FROM embeddings")
def _(spark, sf_dir):
    from quillspark.schema import to_long, to_nested

    back = to_nested(to_long(embedding_strokes(spark, sf_dir), "stroke_id"))
    listed = lambda c: F.transform("points", lambda p: p[c])
    return rounded(back.select("stroke_id", "label", listed("x").alias("xs"), listed("y").alias("ys"), listed("time").alias("times")))
