"""Queries on strokes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import geometry as G
from quillspark.operators import pairs as P
from quillspark.operators import sequence as S
from quillspark.operators import signature as Z
from quillspark.operators import spectral as X
from quillspark.operators import topology as T
from quillspark.plans.registry import query, rounded
from quillspark.schema import embedding_points, embedding_strokes, event_points

R = lambda e, a: f"round({e}, 6) + 0.0 AS {a}"


def pts(spark, sf_dir):
    return embedding_points(spark, sf_dir).drop("pressure")


def box(spark, sf_dir):
    return G.unit_square(pts(spark, sf_dir))


def _column(name, operator, column, sql, uses="stp", source=pts, points="pts"):
    @query(name, f"SELECT stroke_id, i, {R(sql, column)} FROM ({uses_from(uses)})", uses, points)
    def run(spark, sf_dir):
        return rounded(operator(source(spark, sf_dir)).select("stroke_id", "i", column))


def uses_from(uses):
    return f"SELECT *, lag(ds/greatest(dt,1)) OVER w AS pv, atan2(dy,dx) AS ta, lag(atan2(dy,dx)) OVER w AS pta, lead(dx) OVER w AS ndx, lead(dy) OVER w AS ndy, lead(ds) OVER w AS nds, sum(coalesce(ds,0)) OVER (PARTITION BY stroke_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run, lag(dx) OVER w AS pdx, lag(dy) OVER w AS pdy, lag(dt) OVER w AS pdt FROM {uses.split()[-1]} WINDOW w AS (PARTITION BY stroke_id ORDER BY i)"


_column("win01_arc_length", S.arc_length, "arc", "run")
_column("win01_arc_length_events", S.arc_length, "arc", "run", source=event_points, points="evt")
_column("win02_velocity", S.velocity, "velocity", "ds/greatest(dt,1)")
_column("win03_acceleration", S.acceleration, "acceleration", "(ds/greatest(dt,1) - pv)/greatest(dt,1)")
_column("win03_acceleration_events", S.acceleration, "acceleration", "(ds/greatest(dt,1) - pv)/greatest(dt,1)", source=event_points, points="evt")
_column("win04_turn_curvature", S.turn_curvature, "curvature", "CASE WHEN ds*nds > 0 THEN (dx*ndy - dy*ndx)/(ds*nds) WHEN ds*nds = 0 THEN 0 END")
_column("win05_absolute_curvature", lambda p: S.turn_curvature(p, signed=False), "curvature", "abs(CASE WHEN ds*nds > 0 THEN (dx*ndy - dy*ndx)/(ds*nds) WHEN ds*nds = 0 THEN 0 END)")
_column("win06_tangent_angle", S.tangent_angle, "tangent", "ta")
_column("win18_angle_changes", S.angle_changes, "angle_change", "least(abs(ta - pta), 2*pi() - abs(ta - pta))")
_column("win23_affine_arc", S.affine_arc, "sigma", "sum(coalesce(pow(abs((pdx/m)*((dy-pdy)/(m*m)) - ((dx-pdx)/(m*m))*(pdy/m)), 1/3.0::DOUBLE)*m, 0)) OVER (PARTITION BY stroke_id ORDER BY i ROWS UNBOUNDED PRECEDING)".replace("m)", "m)").replace("/m", "/((greatest(dt,1)+greatest(pdt,1))/2)").replace("(m*m)", "(((greatest(dt,1)+greatest(pdt,1))/2)*((greatest(dt,1)+greatest(pdt,1))/2))").replace(")*m,", ")*((greatest(dt,1)+greatest(pdt,1))/2),"))


@query("win07_moving_average", f"SELECT stroke_id, i, {R('avg(x) OVER w', 'x')}, {R('avg(y) OVER w', 'y')} FROM pts WINDOW w AS (PARTITION BY stroke_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "pts")
def _(spark, sf_dir):
    return rounded(S.moving_average(pts(spark, sf_dir), 5).select("stroke_id", "i", "x", "y"))


@query("win08_gaussian_smooth", f"SELECT a.stroke_id, a.i, {R('sum(b.x*exp(-(b.i-a.i)*(b.i-a.i)/2.0::DOUBLE))/sum(exp(-(b.i-a.i)*(b.i-a.i)/2.0::DOUBLE))', 'x')}, {R('sum(b.y*exp(-(b.i-a.i)*(b.i-a.i)/2.0::DOUBLE))/sum(exp(-(b.i-a.i)*(b.i-a.i)/2.0::DOUBLE))', 'y')} FROM pts a JOIN pts b ON a.stroke_id = b.stroke_id AND abs(a.i - b.i) <= 3 GROUP BY 1, 2", "pts")
def _(spark, sf_dir):
    return rounded(S.gaussian_smooth(pts(spark, sf_dir), 1.0).select("stroke_id", "i", "x", "y"))


@query("win10_robust_curvature", f"SELECT stroke_id, k, {R('c', 'c')} FROM rob", "rob")
def _(spark, sf_dir):
    return rounded(S.robust_curvature(pts(spark, sf_dir)).select("stroke_id", "k", "c"))


@query("win11_local_polynomial", """SELECT stroke_id, i, round(c / (1 + abs(c)), 6) + 0.0 AS c FROM (
  SELECT stroke_id, i, CASE WHEN abs(den) < 1e-10 THEN 0 ELSE 2 * (num / den) END AS c FROM (
  SELECT stroke_id, i, 5*b2*b4 - 5*b3*b3 - b1*b1*b4 + 2*b1*b2*b3 - b2*b2*b2 AS den, 5*b2y*b2 - 5*b1y*b3 - b1*b2y*b1 + b1*b1y*b2 + b2*b0y*b3 - b2*b0y*b2 AS num FROM (
  SELECT stroke_id, i, p2+p1+n1+n2 AS b1, p2*p2+p1*p1+n1*n1+n2*n2 AS b2, p2*p2*p2+p1*p1*p1+n1*n1*n1+n2*n2*n2 AS b3, p2*p2*p2*p2+p1*p1*p1*p1+n1*n1*n1*n1+n2*n2*n2*n2 AS b4,
         yp2+yp1+y+yn1+yn2 AS b0y, p2*yp2+p1*yp1+n1*yn1+n2*yn2 AS b1y, p2*p2*yp2+p1*p1*yp1+n1*n1*yn1+n2*n2*yn2 AS b2y FROM (
  SELECT stroke_id, i, y, lag(x,2) OVER w - x AS p2, lag(x) OVER w - x AS p1, lead(x) OVER w - x AS n1, lead(x,2) OVER w - x AS n2, lag(y,2) OVER w AS yp2, lag(y) OVER w AS yp1, lead(y) OVER w AS yn1, lead(y,2) OVER w AS yn2
  FROM box WINDOW w AS (PARTITION BY stroke_id ORDER BY i)) WHERE p2 IS NOT NULL AND n2 IS NOT NULL)))""", "box")
def _(spark, sf_dir):
    # brought into (-1, 1), as small determinants give very large values
    found = S.local_polynomial(box(spark, sf_dir))
    return rounded(found.select("stroke_id", "i", (F.col("c") / (1 + F.abs("c"))).alias("c")))


INFLECTIONS = """SELECT stroke_id, k + 1 AS point, round(abs(nc - pc), 6) + 0.0 AS change, round(spread, 6) + 0.0 AS complexity, round((f1 + f3 + f5)/3.0::DOUBLE, 6) + 0.0 AS stability FROM (
  SELECT *, (lag(c) OVER w * lead(c) OVER w < 0)::INT AS f1, (lag(s3) OVER w * lead(s3) OVER w < 0)::INT AS f3, (lag(s5) OVER w * lead(s5) OVER w < 0)::INT AS f5 FROM (
  SELECT *, lag(c) OVER w AS pc, lead(c) OVER w AS nc, stddev_pop(c) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS spread, avg(c) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s3, avg(c) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s5
  FROM rob WINDOW w AS (PARTITION BY stroke_id ORDER BY k)) WINDOW w AS (PARTITION BY stroke_id ORDER BY k)) WHERE pc*nc < 0 OR (abs(c) < 0.01 AND abs(pc - nc) > 0.1)"""


@query("win12_inflections", INFLECTIONS, "rob")
def _(spark, sf_dir):
    return rounded(S.inflections(S.robust_curvature(pts(spark, sf_dir))))


@query("win38_inflection_pattern", f"SELECT s.stroke_id, coalesce(n, 0)::BIGINT AS n_inflections, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'single' WHEN n = 2 THEN 'double' WHEN n <= 4 THEN 'multiple' WHEN sd < 0.5 * m THEN 'regular' ELSE 'irregular' END AS pattern FROM strokes s LEFT JOIN (SELECT stroke_id, count(*) AS n, avg(change) AS m, stddev_pop(change) AS sd FROM ({INFLECTIONS}) GROUP BY 1) p ON s.stroke_id = p.stroke_id", "strokes rob")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    return S.inflection_pattern(rounded(S.inflections(S.robust_curvature(p))), p)


@query("win15_extrema", "SELECT stroke_id, k + 1 AS point, CASE WHEN c > pc AND c > nc THEN 'maximum' ELSE 'minimum' END AS kind FROM (SELECT *, lag(c) OVER w AS pc, lead(c) OVER w AS nc FROM rob WINDOW w AS (PARTITION BY stroke_id ORDER BY k)) WHERE abs(c) > 0.01 AND ((c > pc AND c > nc) OR (c < pc AND c < nc))", "rob")
def _(spark, sf_dir):
    return S.extrema(S.robust_curvature(pts(spark, sf_dir)))


@query("win17_directions", "SELECT stroke_id, string_agg(CASE WHEN d >= 315 OR d < 45 THEN '→' WHEN d < 135 THEN '↓' WHEN d < 225 THEN '←' ELSE '↑' END, '' ORDER BY i) AS directions FROM (SELECT stroke_id, i, (degrees(atan2(dy, dx)) + 360) % 360 AS d FROM stp WHERE dx IS NOT NULL) GROUP BY 1", "stp")
def _(spark, sf_dir):
    d = S.directions(pts(spark, sf_dir)).where("direction is not null").groupBy("stroke_id").agg(F.array_sort(F.collect_list(F.struct("i", "direction"))).alias("a"))
    return d.select("stroke_id", F.array_join(F.transform("a", lambda s: s.direction), "").alias("directions"))


WRAP = "CASE WHEN {0} > pi() THEN {0} - 2*pi() WHEN {0} < -pi() THEN {0} + 2*pi() ELSE {0} END"


@query("win19_turning_and_windings", f"""SELECT stroke_id, round(coalesce(sum(abs({WRAP.format('(ta - pta)')})), 0), 6) + 0.0 AS total_turning, round(sum({WRAP.format('(ra - pra)')})/(2*pi()), 6) + 0.0 AS origin_winding, round(coalesce(sum(ta), 0)/(2*pi()), 6) + 0.0 AS tangent_winding, 0.0::DOUBLE AS chirality
  FROM (SELECT *, lag(ta) OVER w AS pta, lag(ra) OVER w AS pra FROM (SELECT *, atan2(dy, dx) AS ta, atan2(y, x) AS ra FROM stp) WINDOW w AS (PARTITION BY stroke_id ORDER BY i)) GROUP BY 1""", "stp")
def _(spark, sf_dir):
    p = pts(spark, sf_dir)
    out = S.total_turning(p).join(S.origin_winding(p).withColumnRenamed("winding", "origin_winding"), "stroke_id").join(S.tangent_winding(p).withColumnRenamed("winding", "tangent_winding"), "stroke_id")
    return rounded(out.join(S.chirality(p), "stroke_id"))


ENTROPY = "SELECT s.stroke_id, round(coalesce(h, 0), 6) + 0.0 AS entropy FROM strokes s LEFT JOIN (SELECT stroke_id, sum(-q*log2(q)) AS h FROM (SELECT stroke_id, n / sum(n) OVER (PARTITION BY stroke_id) AS q FROM (SELECT stroke_id, bin, count(*)::DOUBLE AS n FROM ({0}) GROUP BY 1, 2)) GROUP BY 1) e ON s.stroke_id = e.stroke_id"


@query("agg13_curvature_entropy", ENTROPY.format("SELECT stroke_id, least(19, floor((c + t)/(2*t/20))) AS bin FROM (SELECT *, max(abs(c)) OVER (PARTITION BY stroke_id) AS t FROM rob) WHERE t > 0"), "strokes rob")
def _(spark, sf_dir):
    return rounded(S.curvature_entropy(S.robust_curvature(pts(spark, sf_dir))))


@query("agg14_geometric_complexity", ENTROPY.format("SELECT stroke_id, least(9, floor(b/t*10)) AS bin FROM (SELECT *, max(b) OVER (PARTITION BY stroke_id) AS t FROM (SELECT stroke_id, CASE WHEN ar > 0 AND sa*sb*sc > 0 THEN 4*ar/(sa*sb*sc) ELSE 0 END AS b FROM (SELECT stroke_id, sqrt(pow(xp-x,2)+pow(yp-y,2)) AS sa, sqrt(pow(x-xn,2)+pow(y-yn,2)) AS sb, sqrt(pow(xn-xp,2)+pow(yn-yp,2)) AS sc, abs((x-xp)*(yn-yp)-(xn-xp)*(y-yp))/2 AS ar FROM (SELECT *, lag(x) OVER w AS xp, lag(y) OVER w AS yp, lead(x) OVER w AS xn, lead(y) OVER w AS yn FROM pts WINDOW w AS (PARTITION BY stroke_id ORDER BY i)) WHERE xp IS NOT NULL AND xn IS NOT NULL))) WHERE t > 0"), "strokes")
def _(spark, sf_dir):
    return rounded(G.geometric_complexity(pts(spark, sf_dir)))


@query("win39_curvature_metrics", f"""WITH sc AS (SELECT stroke_id, i, k, CASE WHEN t > 0 THEN c/t ELSE 0 END AS c FROM (SELECT *, max(abs(c)) OVER (PARTITION BY stroke_id) AS t FROM rob)),
  a AS (SELECT stroke_id, sum(abs(c)) AS total, avg(c) AS mean, var_pop(c) AS variance, count(*) AS n FROM sc GROUP BY 1),
  e AS (SELECT stroke_id, count(*) FILTER ((pc*nc < 0) OR (abs(c) < 0.01 AND abs(pc-nc) > 0.1)) AS ni, count(*) FILTER (abs(c) > 0.01 AND ((c > pc AND c > nc) OR (c < pc AND c < nc))) AS ne FROM (SELECT *, lag(c) OVER w AS pc, lead(c) OVER w AS nc FROM sc WINDOW w AS (PARTITION BY stroke_id ORDER BY k)) GROUP BY 1)
  SELECT stroke_id, {R('total', 'total')}, {R('mean', 'mean')}, {R('variance', 'variance')}, ni AS n_inflections, ne AS n_extrema, {R('sqrt(variance) + 5*ni/n::DOUBLE + 0.1::DOUBLE*ne', 'complexity')}, {R('1 - least(1, variance)', 'regularity')} FROM a JOIN e USING (stroke_id)""", "rob")
def _(spark, sf_dir):
    return rounded(S.curvature_metrics(pts(spark, sf_dir)))


@query("geo01_unit_square", f"SELECT stroke_id, i, {R('x', 'x')}, {R('y', 'y')} FROM box", "box")
def _(spark, sf_dir):
    return rounded(box(spark, sf_dir).select("stroke_id", "i", "x", "y"))


@query("geo06_decimate", "SELECT stroke_id, i FROM (SELECT *, count(*) OVER (PARTITION BY stroke_id) AS n FROM evt) WHERE i % ceil(n/20.0::DOUBLE) = 0", "evt")
def _(spark, sf_dir):
    return G.decimate(event_points(spark, sf_dir), 20).select("stroke_id", "i")


@query("geo04_catmull_rom", f"""WITH p AS (SELECT *, coalesce(lag(x) OVER w, x) AS xa, coalesce(lag(y) OVER w, y) AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb, coalesce(lead(x, 2) OVER w, lead(x) OVER w) AS xd, coalesce(lead(y, 2) OVER w, lead(y) OVER w) AS yd, lead(time) OVER w AS tb FROM pts WINDOW w AS (PARTITION BY stroke_id ORDER BY i)),
  q AS (SELECT *, j/3.0::DOUBLE AS t FROM p, range(3) r(j) WHERE tb IS NOT NULL OR j = 0)
  SELECT stroke_id, i AS segment, j::INT AS j, {R('CASE WHEN j = 0 THEN x ELSE 0.5*(2*x + (xb-xa)*t + (2*xa-5*x+4*xb-xd)*t*t + (3*x-xa-3*xb+xd)*t*t*t) END', 'x')}, {R('CASE WHEN j = 0 THEN y ELSE 0.5*(2*y + (yb-ya)*t + (2*ya-5*y+4*yb-yd)*t*t + (3*y-ya-3*yb+yd)*t*t*t) END', 'y')}, {R('CASE WHEN j = 0 THEN time ELSE time + t*(tb-time) END', 'time')} FROM q""", "pts")
def _(spark, sf_dir):
    return rounded(G.catmull_rom(pts(spark, sf_dir), 100))


@query("geo05_resample", f"""WITH l AS (SELECT *, sum(coalesce(ds, 0)) OVER (PARTITION BY stroke_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS arc FROM stp),
  m AS (SELECT *, max(arc) OVER (PARTITION BY stroke_id) AS total, lag(arc) OVER w AS aa, lag(x) OVER w AS xa, lag(y) OVER w AS ya, lag(time) OVER w AS ta FROM l WINDOW w AS (PARTITION BY stroke_id ORDER BY i)),
  c AS (SELECT *, least(k * (total/15), total) AS want, row_number() OVER (PARTITION BY stroke_id, k ORDER BY i) AS rn FROM m, range(16) r(k) WHERE i >= 1 AND arc >= least(k * (total/15), total))
  SELECT stroke_id, k::INT AS k, {R('xa + t*(x-xa)', 'x')}, {R('ya + t*(y-ya)', 'y')} FROM (SELECT *, CASE WHEN arc > aa THEN (want-aa)/(arc-aa) ELSE 0 END AS t FROM c WHERE rn = 1)""", "stp")
def _(spark, sf_dir):
    return rounded(G.resample(pts(spark, sf_dir), 16).select("stroke_id", "k", "x", "y"))


@query("geo08_symmetry", f"SELECT stroke_id, {R('avg(exp(-10*d))', 'symmetry')} FROM (SELECT a.stroke_id, a.i, min(sqrt((b.x-(1-a.x))*(b.x-(1-a.x)) + (b.y-a.y)*(b.y-a.y))) AS d FROM box a JOIN box b ON a.stroke_id = b.stroke_id GROUP BY 1, 2) GROUP BY 1", "box")
def _(spark, sf_dir):
    return rounded(G.symmetry(box(spark, sf_dir)))


MEETS = " + ".join(f"(((p{{0}} <= {v} AND {{0}} >= {v}) OR (p{{0}} >= {v} AND {{0}} <= {v}))::BIGINT)" for v in (0.25, 0.5, 0.75))


@query("jn12_line_crossings", f"SELECT stroke_id, sum({MEETS.format('y')})::BIGINT AS horizontal, sum({MEETS.format('x')})::BIGINT AS vertical FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM box WINDOW w AS (PARTITION BY stroke_id ORDER BY i)) WHERE px IS NOT NULL GROUP BY 1", "box")
def _(spark, sf_dir):
    return G.line_crossings(box(spark, sf_dir))


@query("geo13_shape", f"SELECT stroke_id, {R('CASE WHEN max(y) > min(y) THEN (max(x)-min(x))/(max(y)-min(y)) ELSE 1 END', 'box_ratio')}, {R('avg(x)', 'center_x')}, {R('avg(y)', 'center_y')} FROM pts GROUP BY 1", "pts")
def _(spark, sf_dir):
    return rounded(G.shape(pts(spark, sf_dir)))


MOTION = """SELECT stroke_id, least(coalesce(sqrt(avg(cv*cv)), 0)*10 + coalesce(avg(tu), 0), 10) AS complexity, CASE WHEN avg(ve) > 0 THEN greatest(0, 1 - stddev_pop(ve)/avg(ve)) ELSE 0 END AS regularity FROM (
  SELECT stroke_id, ds/greatest(dt, 1) AS ve, least(abs(ta-pta), 2*pi()-abs(ta-pta)) AS tu, CASE WHEN ds*nds > 0 THEN (dx*ndy-dy*ndx)/(ds*nds) WHEN ds*nds = 0 THEN 0 END AS cv FROM (SELECT *, atan2(dy,dx) AS ta, lag(atan2(dy,dx)) OVER w AS pta, lead(dx) OVER w AS ndx, lead(dy) OVER w AS ndy, lead(ds) OVER w AS nds FROM stp WINDOW w AS (PARTITION BY stroke_id ORDER BY i))) GROUP BY 1"""


@query("geo10_motion_scores", f"SELECT stroke_id, {R('complexity', 'complexity')}, {R('regularity', 'regularity')} FROM ({MOTION})", "stp", "box")
def _(spark, sf_dir):
    return rounded(G.motion_scores(box(spark, sf_dir)))


def _drawing(p):
    lines = G.line_crossings(p).select("stroke_id", (F.col("horizontal") + F.col("vertical")).alias("crossings"))
    short = X.short_spectrum(S.tangent_angle(p).where("tangent is not null").select("stroke_id", (F.col("i") - 1).alias("k"), F.col("tangent").alias("v")))
    centroid = short.groupBy("stroke_id").agg((F.sum(F.col("magnitude") * F.col("k")) / (1 + F.sum("magnitude"))).alias("spectral_centroid"))
    return lines.join(G.motion_scores(p), "stroke_id").join(centroid, "stroke_id").join(G.symmetry(p, 1), "stroke_id")


@query("geo14_feature_vector", f"""WITH m AS ({MOTION}), c AS (SELECT stroke_id, sum(mag*f)/(1 + sum(mag)) AS sc FROM (SELECT stroke_id, f, sqrt(pow(sum(v*cos(-2*pi()*f*k/31)),2) + pow(sum(v*sin(-2*pi()*f*k/31)),2))/31 AS mag FROM (SELECT stroke_id, i-1 AS k, atan2(dy,dx) AS v FROM stp WHERE dx IS NOT NULL), range(16) q(f) GROUP BY 1, 2) GROUP BY 1),
  s AS (SELECT stroke_id, avg(exp(-10*d)) AS symmetry FROM (SELECT a.stroke_id, a.i, min(sqrt((b.x-(1-a.x))*(b.x-(1-a.x)) + (b.y-a.y)*(b.y-a.y))) AS d FROM box a JOIN box b ON a.stroke_id = b.stroke_id GROUP BY 1, 2) GROUP BY 1),
  l AS (SELECT stroke_id, sum({MEETS.format('y')} + {MEETS.format('x')})::BIGINT AS crossings FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM box WINDOW w AS (PARTITION BY stroke_id ORDER BY i)) WHERE px IS NOT NULL GROUP BY 1)
  SELECT stroke_id, crossings, {R('complexity', 'complexity')}, {R('regularity', 'regularity')}, {R('sc', 'spectral_centroid')}, {R('symmetry', 'symmetry')} FROM l JOIN m USING (stroke_id) JOIN c USING (stroke_id) JOIN s USING (stroke_id)""", "stp box", "box")
def _(spark, sf_dir):
    return rounded(_drawing(box(spark, sf_dir)))


#: The sixteen sums of the fourth level: ten words of the mean place and the last three steps, and six others.
MEAN = {c: f"(({c}3 + {c}2 + {c}1 + {c}) / 4)" for c in "xy"}
WORDS = ("xxxx", "xxxy", "xxyx", "xyxx", "yxxx", "xyyy", "yxyy", "yyxy", "yyyx", "yyyy")
OTHERS = (
    f"{MEAN['x']} * {MEAN['x']} * dx2 * dy2", f"{MEAN['y']} * {MEAN['y']} * dx2 * dy2", f"{MEAN['x']} * {MEAN['y']} * dx2 * dx1", f"{MEAN['x']} * {MEAN['y']} * dy2 * dy1",
    "CASE WHEN x3 IS NOT NULL THEN abs(dx2 * dy1 - dy2 * dx1) END", "CASE WHEN x3 IS NOT NULL THEN sqrt(dx2 * dx2 + dy2 * dy2) * sqrt(dx1 * dx1 + dy1 * dy1) END",
)
LEVEL4 = [R(f"sum({term})", f"s4_{k}") for k, term in enumerate([*(f"{MEAN[w[0]]} * d{w[1]}2 * d{w[2]}1 * d{w[3]}" for w in WORDS), *OTHERS])]


@query("sig_levels", f"""SELECT stroke_id, {', '.join([R('max_by(x, i) - min_by(x, i)', 's_x'), R('max_by(y, i) - min_by(y, i)', 's_y')] + [R(f'sum(({a}1+{a})*0.5*d{b})', f's_{a}{b}') for a in 'xy' for b in 'xy'] + [R(f'sum(({a}2+{a}1+{a})/3*d{b}1*d{c})', f's_{a}{b}{c}') for a in 'xy' for b in 'xy' for c in 'xy'] + [R('sqrt(sum(ds*ds))', 'variation')] + LEVEL4)} FROM (
  SELECT *, lag(x) OVER w AS x1, lag(y) OVER w AS y1, lag(x,2) OVER w AS x2, lag(y,2) OVER w AS y2, lag(x,3) OVER w AS x3, lag(y,3) OVER w AS y3, lag(dx) OVER w AS dx1, lag(dy) OVER w AS dy1, lag(dx,2) OVER w AS dx2, lag(dy,2) OVER w AS dy2 FROM (SELECT *, sqrt(dx*dx+dy*dy) AS ds FROM (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM (
  SELECT stroke_id, i, (x - avg(x) OVER s)/sum(coalesce(ds,0)) OVER s AS x, (y - avg(y) OVER s)/sum(coalesce(ds,0)) OVER s AS y FROM stp WINDOW s AS (PARTITION BY stroke_id)) WINDOW w AS (PARTITION BY stroke_id ORDER BY i))) WINDOW w AS (PARTITION BY stroke_id ORDER BY i)) GROUP BY 1""", "stp")
def path_signature(spark, sf_dir):
    return rounded(Z.levels(Z.normalised(pts(spark, sf_dir))))


@query("jn03_rips_edges", f"SELECT stroke_id, a, b, {R('d', 'd')} FROM pairs WHERE d <= 0.1", "pairs", "box")
def _(spark, sf_dir):
    return rounded(P.rips_edges(box(spark, sf_dir), 0.1))


@query("jn04_rips_triangles", """SELECT stroke_id, a, b, c FROM (
  SELECT stroke_id, a, unnest(list_filter(bs, lambda p: len(list_filter(bs, lambda q: q > p)) > 0)) AS b, bs FROM (SELECT stroke_id, a, list(b) AS bs FROM pairs WHERE d <= 0.2 GROUP BY 1, 2)) t
  JOIN (SELECT stroke_id, a AS b, b AS c FROM pairs WHERE d <= 0.2) e USING (stroke_id, b) WHERE list_contains(bs, c)""", "pairs", "box")
def _(spark, sf_dir):
    return P.rips_triangles(P.rips_edges(box(spark, sf_dir), 0.2))


@query("jn13_loop_signature", """SELECT s.stroke_id, coalesce(l, []::DOUBLE[]) AS loops FROM strokes s LEFT JOIN (
  SELECT stroke_id, list_reverse_sort(list(round((b - a) / 32.0::DOUBLE, 6))) AS l FROM pairs WHERE b - a > 2 AND d < 0.1 GROUP BY 1) q ON s.stroke_id = q.stroke_id""", "strokes pairs", "box")
def _(spark, sf_dir):
    return rounded(P.loop_signature(box(spark, sf_dir)))


CROSS = """SELECT stroke_id, s, t, px + al*vx AS cx, py + al*vy AS cy, CASE WHEN den > 0 THEN 1 ELSE -1 END AS sign, acos(greatest(-1, least(1, (vx*ux+vy*uy)/(sqrt(vx*vx+vy*vy)*sqrt(ux*ux+uy*uy))))) AS angle FROM (SELECT *, ((qx-px)*uy-(qy-py)*ux)/den AS al, ((qx-px)*vy-(qy-py)*vx)/den AS ac FROM (SELECT *, vx*uy-vy*ux AS den FROM sp) WHERE abs(den) >= 1e-10) WHERE al BETWEEN 0 AND 1 AND ac BETWEEN 0 AND 1"""


@query("geo19_crossings", f"SELECT stroke_id, s, t, {R('cx', 'cx')}, {R('cy', 'cy')}, sign, {R('angle', 'angle')} FROM ({CROSS})", "sp", "box")
def _(spark, sf_dir):
    return rounded(P.crossings(box(spark, sf_dir)))


@query("geo21_writhe", f"SELECT s.stroke_id, round(coalesce(w, 0), 6) + 0.0 AS writhe FROM strokes s LEFT JOIN (SELECT stroke_id, sum(CASE WHEN vx*uy-vy*ux > 0 THEN 1 ELSE -1 END * atan2(vx*uy-vy*ux, vx*ux+vy*uy))/(4*pi()) AS w FROM sp WHERE (vx*(qy-py)-vy*(qx-px))*(vx*(qy2-py)-vy*(qx2-px)) < 0 GROUP BY 1) q ON s.stroke_id = q.stroke_id", "strokes sp", "box")
def _(spark, sf_dir):
    return rounded(P.writhe(box(spark, sf_dir)))


@query("geo23_knot_features", f"""WITH c AS (SELECT stroke_id, count(*) AS n, count(*) FILTER (sign > 0) AS np, avg(angle) AS a FROM ({CROSS}) GROUP BY 1)
  SELECT s.stroke_id, coalesce(n, 0)::BIGINT AS n_crossings, coalesce(np, 0)::BIGINT AS n_positive, (coalesce(2*np - n, 0))::BIGINT AS balance, round(coalesce(a, 0), 6) + 0.0 AS mean_angle FROM strokes s LEFT JOIN c ON s.stroke_id = c.stroke_id""", "strokes sp", "box")
def _(spark, sf_dir):
    p = box(spark, sf_dir)
    c = P.crossings(p).groupBy("stroke_id").agg(F.count("*").alias("n"), F.count_if(F.col("sign") > 0).alias("np"), F.avg("angle").alias("a"))
    zero = lambda e: F.coalesce(e, F.lit(0)).cast("long")
    out = p.select("stroke_id").distinct().join(c, "stroke_id", "left")
    return rounded(out.select("stroke_id", zero(F.col("n")).alias("n_crossings"), zero(F.col("np")).alias("n_positive"), zero(2 * F.col("np") - F.col("n")).alias("balance"), F.coalesce("a", F.lit(0.0)).alias("mean_angle")))


@query("jn15_apart", "WITH r AS (SELECT stroke_id, i AS idx, row_number() OVER (PARTITION BY stroke_id ORDER BY x, i) AS pos FROM box) SELECT stroke_id, idx, pos FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.stroke_id = r.stroke_id AND abs(o.idx - r.idx) < 2 AND o.pos < r.pos)", "box")
def _(spark, sf_dir):
    from pyspark.sql import Window

    rows = box(spark, sf_dir).select("stroke_id", F.col("i").alias("idx"), F.row_number().over(Window.partitionBy("stroke_id").orderBy("x", "i")).alias("pos"))
    return P.apart(rows)


@query("topo02_components", f"""WITH e AS (SELECT stroke_id, a, b, d, row_number() OVER (PARTITION BY stroke_id ORDER BY d, a, b) AS pos FROM (SELECT *, rank() OVER (PARTITION BY stroke_id ORDER BY d) AS rk FROM pairs WHERE d <= 0.5) WHERE rk <= 20),
  f AS (SELECT stroke_id, 0::BIGINT AS pos, range(32) AS piece, []::DOUBLE[] AS deaths FROM strokes UNION ALL
  SELECT f.stroke_id, e.pos, list_transform(f.piece, lambda p: CASE WHEN p = f.piece[e.b+1] THEN f.piece[e.a+1] ELSE p END), CASE WHEN f.piece[e.a+1] = f.piece[e.b+1] THEN f.deaths ELSE list_append(f.deaths, e.d) END FROM f JOIN e ON f.stroke_id = e.stroke_id AND e.pos = f.pos + 1),
  l AS (SELECT stroke_id, max_by(deaths, pos) AS deaths FROM f GROUP BY 1)
  SELECT stroke_id, (32 - len(deaths) + len(list_filter(deaths, lambda d: d > 1e-10 AND d > 0.1)))::BIGINT AS b0, (32 - len(deaths))::BIGINT AS n_infinite, {R('coalesce(list_sum(list_filter(deaths, lambda d: d > 1e-10)), 0)', 'persistence')}, {R('coalesce(list_sum(list_transform(list_filter(deaths, lambda d: d > 1e-10), lambda d: ln(1 + d))), 0)', 'complexity')} FROM l""", "strokes pairs", "box")
def _(spark, sf_dir):
    return rounded(T.betti_zero(T.merge_distances(box(spark, sf_dir))))


@query("topo_euler", "WITH e AS (SELECT * FROM pairs WHERE d <= 0.2), t AS (SELECT p.stroke_id, count(*) AS n FROM e p JOIN e q ON p.stroke_id = q.stroke_id AND p.b = q.a JOIN e r ON r.stroke_id = p.stroke_id AND r.a = p.a AND r.b = q.b GROUP BY 1), g AS (SELECT stroke_id, count(*) AS n FROM e GROUP BY 1) SELECT s.stroke_id, (32 - coalesce(g.n, 0) + coalesce(t.n, 0))::BIGINT AS euler FROM strokes s LEFT JOIN g ON s.stroke_id = g.stroke_id LEFT JOIN t ON s.stroke_id = t.stroke_id", "strokes pairs", "box")
def _(spark, sf_dir):
    p = box(spark, sf_dir)
    e = P.rips_edges(p, 0.2)
    return T.betti_one(e, p.groupBy("stroke_id").agg(F.count("*").alias("n")), P.rips_triangles(e))


@query("spc01_spectrum", f"SELECT stroke_id, k::INT AS k, {R('power', 'power')} FROM psd", "psd")
def _(spark, sf_dir):
    return rounded(X.spectrum(X.tangent_signal(pts(spark, sf_dir))).select("stroke_id", "k", "power"))


@query("spc04_moments", f"WITH t AS (SELECT *, sum(power) OVER (PARTITION BY stroke_id) AS total, sum(power) OVER (PARTITION BY stroke_id ORDER BY k) AS run FROM psd) SELECT stroke_id, {R('sum(k*power)/max(total)', 'centroid')}, {R('coalesce(min(CASE WHEN run >= 0.85::DOUBLE*total THEN k END)/32.0::DOUBLE, 1)', 'rolloff')}, {R('kurtosis_pop(power)', 'kurtosis')} FROM t GROUP BY 1", "psd")
def _(spark, sf_dir):
    return rounded(X.moments(X.spectrum(X.tangent_signal(pts(spark, sf_dir)))))


@query("spc12_bands", f"SELECT stroke_id, {R('sum(CASE WHEN k < 3 THEN power ELSE 0 END)/sum(power)', 'low_energy')}, {R('sum(CASE WHEN k >= 3 AND k < 16 THEN power ELSE 0 END)/sum(power)', 'mid_energy')}, {R('sum(CASE WHEN k >= 16 THEN power ELSE 0 END)/sum(power)', 'high_energy')} FROM psd GROUP BY 1", "psd")
def _(spark, sf_dir):
    return rounded(X.bands(X.spectrum(X.tangent_signal(pts(spark, sf_dir)))))


@query("spc09_wavelet_energy", f"""WITH l0 AS (SELECT stroke_id, k, v FROM sig),
  {', '.join(f"l{n} AS (SELECT stroke_id, k//2 AS k, (sum(CASE WHEN k % 2 = 0 THEN v END) + sum(CASE WHEN k % 2 = 1 THEN v END))/sqrt(2.0::DOUBLE) AS v, (sum(CASE WHEN k % 2 = 0 THEN v END) - sum(CASE WHEN k % 2 = 1 THEN v END))/sqrt(2.0::DOUBLE) AS d FROM l{n-1} GROUP BY 1, k//2)" for n in (1, 2, 3, 4))},
  t AS (SELECT stroke_id, sum(v*v) AS total FROM sig GROUP BY 1), u AS ({' UNION ALL '.join(f'SELECT stroke_id, {n} AS level, sum(d*d) AS e FROM l{n} GROUP BY 1' for n in (1, 2, 3, 4))})
  SELECT stroke_id, level, {R('e/total', 'share')} FROM u JOIN t USING (stroke_id)""", "sig")
def _(spark, sf_dir):
    return rounded(X.haar(X.tangent_signal(pts(spark, sf_dir))))


@query("spc08_dominant", f"SELECT stroke_id, place::INT AS place, {R('k/32.0::DOUBLE', 'frequency')} FROM (SELECT *, row_number() OVER (PARTITION BY stroke_id ORDER BY round(power, 9) DESC, k) AS place FROM (SELECT *, lag(power) OVER w AS lo, lead(power) OVER w AS hi FROM psd WINDOW w AS (PARTITION BY stroke_id ORDER BY k)) WHERE power > lo AND power > hi AND power > 0.01) WHERE place <= 5", "psd")
def _(spark, sf_dir):
    return rounded(X.dominant(X.tangent_spectrum(pts(spark, sf_dir))))
