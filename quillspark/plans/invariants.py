"""Queries on invariant points, each SQL form in a block of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import invariants as V
from quillspark.operators import pairs as P
from quillspark.plans.registry import query, rounded
from quillspark.plans.strokes import box

#: Curvature of the inner points as the sine of the turn, with its neighbours.
BENT = """
bent AS (
  SELECT *, lag(c) OVER w AS was, lead(c) OVER w AS next
  FROM (SELECT stroke_id, i, CASE WHEN ds * nds > 0 THEN abs(dx * ndy - dy * ndx) / (ds * nds) ELSE 0 END AS c
        FROM (SELECT *, lead(dx) OVER o AS ndx, lead(dy) OVER o AS ndy, lead(ds) OVER o AS nds
              FROM stp WINDOW o AS (PARTITION BY stroke_id ORDER BY i))
        WHERE ds IS NOT NULL AND nds IS NOT NULL)
  WINDOW w AS (PARTITION BY stroke_id ORDER BY i))"""

GEOMETRIC = """
geometric AS (
  SELECT stroke_id, i::BIGINT AS idx, least(c, 1) AS stability, CASE WHEN c > 0.8 THEN 'primary' ELSE 'secondary' END AS type,
         'geometric' AS category, 0 AS block, i::BIGINT AS one, 0::BIGINT AS two
  FROM bent WHERE c > 0.5
  UNION ALL
  SELECT stroke_id, idx::BIGINT, 0.8::DOUBLE, 'secondary', 'geometric', 1, side::BIGINT, 0
  FROM (SELECT stroke_id, unnest([arg_min(i, (x, i)), arg_min(i, (-x, i)), arg_min(i, (y, i)), arg_min(i, (-y, i))]) AS idx, unnest([0, 1, 2, 3]) AS side
        FROM box GROUP BY 1 HAVING count(*) >= 3)
  UNION ALL
  SELECT stroke_id, i, 0.6::DOUBLE, 'tertiary', 'geometric', 2, i, 0
  FROM bent WHERE abs(c - was) > 0.3 AND abs(next - c) > 0.3)"""

#: Distance of (x, y) from the segment q.
AWAY = """sqrt(pow({x} - q.x - t{k} * (q.x2 - q.x), 2) + pow({y} - q.y - t{k} * (q.y2 - q.y), 2))"""
SHARE = """CASE WHEN pow(q.x2 - q.x, 2) + pow(q.y2 - q.y, 2) > 0 THEN greatest(0, least(1, (({x} - q.x) * (q.x2 - q.x) + ({y} - q.y) * (q.y2 - q.y))
  / (pow(q.x2 - q.x, 2) + pow(q.y2 - q.y, 2)))) ELSE 0 END"""


def near(eps: float) -> str:
    ends = (("p.x", "p.y"), ("p.x2", "p.y2"))
    shares = ", ".join(f"{SHARE.format(x=x, y=y)} AS t{k}" for k, (x, y) in enumerate(ends))
    away = " AND ".join(f"{AWAY.format(x=x, y=y, k=k).replace('p.', 'p').replace('q.', 'q')} < {eps}" for k, (x, y) in enumerate(ends))
    return f"""
near AS (
  SELECT stroke_id, s, t, floor((s + t) / 2.0::DOUBLE)::BIGINT AS idx
  FROM (SELECT p.stroke_id, p.i AS s, q.i AS t, p.x AS px, p.y AS py, p.x2 AS px2, p.y2 AS py2, q.x AS qx, q.y AS qy, q.x2 AS qx2, q.y2 AS qy2, {shares}
        FROM seg p JOIN seg q ON p.stroke_id = q.stroke_id AND q.i >= p.i + 2)
  WHERE {away})"""


TOPOLOGICAL = """
topological AS (
  SELECT stroke_id, unnest([0, max(i)])::BIGINT AS idx, 0.95::DOUBLE AS stability, 'primary' AS type, 'topological' AS category,
         3 AS block, unnest([0, 1])::BIGINT AS one, 0::BIGINT AS two
  FROM box GROUP BY 1 HAVING count(*) >= 2
  UNION ALL
  SELECT stroke_id, idx, 0.7::DOUBLE, 'secondary', 'topological', 4, s, t FROM near)"""

LINES = """
met AS (
  SELECT stroke_id, i, axis, line, CASE WHEN now = was THEN 'NaN'::DOUBLE ELSE a + (v - was) / (now - was) * (b - a) END AS place
  FROM (SELECT stroke_id, i, axis, line, (line + 1) * 0.25::DOUBLE AS v, CASE axis WHEN 0 THEN py ELSE px END AS was, CASE axis WHEN 0 THEN y ELSE x END AS now,
               CASE axis WHEN 0 THEN px ELSE py END AS a, CASE axis WHEN 0 THEN x ELSE y END AS b
        FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM box WINDOW w AS (PARTITION BY stroke_id ORDER BY i)), range(2) r(axis), range(3) q(line)
        WHERE px IS NOT NULL)
  WHERE (was <= v AND now >= v) OR (was >= v AND now <= v))"""

REST = """
statistical AS (
  SELECT stroke_id, i::BIGINT AS idx, 0.7::DOUBLE - 0.1::DOUBLE * q AS stability, CASE q WHEN 2 THEN 'secondary' ELSE 'tertiary' END AS type,
         'statistical' AS category, 5 AS block, q::BIGINT AS one, 0::BIGINT AS two
  FROM (SELECT *, count(*) OVER (PARTITION BY stroke_id) AS n FROM box), range(1, 4) r(q) WHERE i = floor(n * q / 4.0::DOUBLE)),
intersecting AS (
  SELECT stroke_id, i::BIGINT AS idx, 0.5::DOUBLE AS stability, 'tertiary' AS type, 'intersection' AS category, 6 AS block, i::BIGINT AS one, axis * 3 + line AS two
  FROM met)"""

FOUND = f"""
{near(0.05)},
{TOPOLOGICAL},
{LINES},
{REST},
every AS (SELECT * FROM geometric UNION ALL SELECT * FROM topological UNION ALL SELECT * FROM statistical UNION ALL SELECT * FROM intersecting),
placed AS (SELECT *, row_number() OVER (PARTITION BY stroke_id ORDER BY block, one, two) AS pos FROM every),
lone AS (SELECT * FROM placed p WHERE NOT EXISTS (SELECT 1 FROM placed o WHERE o.stroke_id = p.stroke_id AND abs(o.idx - p.idx) < 2 AND o.pos < p.pos)),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY stroke_id ORDER BY stability DESC, pos))::INT AS place FROM lone),
found AS (SELECT stroke_id, place, idx, round(stability, 6) AS stability, type, category FROM ranked WHERE place <= 20)"""
SHOWN = "stroke_id, idx, round(stability, 6) AS stability, type, category, one, two"


@query("geo26_geometric_invariants", f"WITH {BENT}, {GEOMETRIC} SELECT {SHOWN} FROM geometric", "stp box", "box")
def _(spark, sf_dir):
    return rounded(V.geometric(box(spark, sf_dir)).drop("block"))


@query("geo27_topological_invariants", f"WITH {near(0.05)}, {TOPOLOGICAL} SELECT {SHOWN} FROM topological", "seg box", "box")
def _(spark, sf_dir):
    return rounded(V.topological(box(spark, sf_dir)).drop("block"))


@query("geo29_line_crossings", f"WITH {LINES} SELECT stroke_id, i, axis::INT AS axis, line::INT AS line, round(place, 6) + 0.0 AS place FROM met", "box")
def _(spark, sf_dir):
    return rounded(V.crossings_of_lines(box(spark, sf_dir)))


@query("geo30_invariant_points", f"WITH {BENT}, {GEOMETRIC}, {FOUND} SELECT * FROM found", "stp seg box", "box")
def _(spark, sf_dir):
    return rounded(V.invariant_points(box(spark, sf_dir)))


@query("agg11_invariant_summary", f"""WITH {BENT}, {GEOMETRIC}, {FOUND}
SELECT category, count(*) AS n, count(*) FILTER (type = 'primary') AS "primary", count(*) FILTER (type = 'secondary') AS secondary, count(*) FILTER (type = 'tertiary') AS tertiary,
       round(count(*) / sum(count(*)) OVER () * 100, 6) AS percentage
FROM found GROUP BY 1""", "stp seg box", "box")
def _(spark, sf_dir):
    return rounded(V.summary(V.invariant_points(box(spark, sf_dir))))


@query("top09_outermost", "SELECT stroke_id, count(*) AS n, unnest([0, 1, 2, 3]) AS side, unnest([arg_min(i, (x, i)), arg_min(i, (-x, i)), arg_min(i, (y, i)), arg_min(i, (-y, i))]) AS i FROM box GROUP BY 1", "box")
def _(spark, sf_dir):
    return V.outermost(box(spark, sf_dir))


@query("geo32_landmark_indices", "SELECT stroke_id, floor(x * count(*) OVER (PARTITION BY stroke_id))::BIGINT AS idx, 1.0::DOUBLE AS stability, 'point' AS kind FROM box", "box")
def _(spark, sf_dir):
    p = box(spark, sf_dir)
    marks = p.select("stroke_id", "x", F.lit("point").alias("kind"), F.lit(1.0).alias("stability"))
    return V.of_landmarks(marks, p.groupBy("stroke_id").agg(F.count("*").alias("n")))


@query("jn16_near_segments", f"WITH {near(0.2)} SELECT * FROM near", "seg", "box")
def _(spark, sf_dir):
    return P.near_segments(box(spark, sf_dir), 0.2)
