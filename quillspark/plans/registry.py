"""The registered queries, each with its SQL form where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The bodies of SQL forms and the common tables they use, from which they can be formed again over other points.
BODIES: dict[str, tuple[str, str]] = {}

#: Common tables that the SQL forms may name: strokes of the embeddings, their points with neighbours, strokes of the events.
COMMON = {
    "pts": "SELECT vec_id AS stroke_id, label::VARCHAR AS label, i::INT AS i, embedding[2*i+1]::DOUBLE AS x, embedding[2*i+2]::DOUBLE AS y, 10.0::DOUBLE * i AS time FROM embeddings, range(32) r(i)",
    "evt": "SELECT user_id AS stroke_id, event_type AS label, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS i, (epoch_us(ts) - 1704067200000000)::DOUBLE / 1000000 / 86400 AS x, value AS y, floor(epoch_us(ts)::DOUBLE / 1000) AS time, (props->>'$.k')::DOUBLE / 100 AS pressure FROM events",
    "box": "SELECT stroke_id, label, i, time, (x - min(x) OVER s) / CASE WHEN max(x) OVER s = min(x) OVER s THEN 1 ELSE max(x) OVER s - min(x) OVER s END AS x, (y - min(y) OVER s) / CASE WHEN max(y) OVER s = min(y) OVER s THEN 1 ELSE max(y) OVER s - min(y) OVER s END AS y FROM pts WINDOW s AS (PARTITION BY stroke_id)",
    "stp": "SELECT *, sqrt(dx*dx + dy*dy) AS ds FROM (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, time - lag(time) OVER w AS dt FROM {points} WINDOW w AS (PARTITION BY stroke_id ORDER BY i))",
    "cur": "SELECT stroke_id, i, i - 1 AS k, CASE WHEN dx*dx + dy*dy > 0 THEN (dx * (ndy - dy) - dy * (ndx - dx)) / pow(dx*dx + dy*dy, 1.5) ELSE 0 END AS c FROM (SELECT *, lead(dx) OVER w AS ndx, lead(dy) OVER w AS ndy FROM stp WINDOW w AS (PARTITION BY stroke_id ORDER BY i)) WHERE ndx - dx IS NOT NULL",
    "rob": "SELECT stroke_id, i, k, m[(len(m) // 2) + 1] AS c FROM (SELECT stroke_id, i, k, list_sort(list_filter(CASE WHEN k = 0 THEN [c, n1, n2] ELSE [p1, c, n1] END, lambda v: v IS NOT NULL)) AS m FROM (SELECT *, lag(c) OVER w AS p1, lead(c) OVER w AS n1, lead(c, 2) OVER w AS n2 FROM cur WINDOW w AS (PARTITION BY stroke_id ORDER BY k)))",
    "strokes": "SELECT DISTINCT stroke_id FROM pts",
    "pairs": "SELECT a.stroke_id, a.i AS a, b.i AS b, sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y)) AS d FROM {points} a JOIN {points} b ON a.stroke_id = b.stroke_id AND a.i < b.i",
    "seg": "SELECT * FROM (SELECT stroke_id, i, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY stroke_id) AS n FROM {points} WINDOW w AS (PARTITION BY stroke_id ORDER BY i)) WHERE x2 IS NOT NULL",
    "sp": "SELECT p.stroke_id, p.i AS s, q.i AS t, p.x AS px, p.y AS py, p.x2 - p.x AS vx, p.y2 - p.y AS vy, q.x AS qx, q.y AS qy, q.x2 AS qx2, q.y2 AS qy2, q.x2 - q.x AS ux, q.y2 - q.y AS uy FROM seg p JOIN seg q ON p.stroke_id = q.stroke_id AND q.i >= p.i + 2 AND NOT (p.i = 0 AND q.i = p.n - 2)",
    "sig": "SELECT stroke_id, i, k, v, n FROM (SELECT stroke_id, i AS k, i, coalesce(atan2(dy, dx), 0) AS v, count(*) OVER (PARTITION BY stroke_id)::INT AS n FROM stp)",
    "pow": "SELECT stroke_id, f AS k, sum(v * cos(-2 * pi() * ((f * k) % 32) / 32)) AS re, sum(v * sin(-2 * pi() * ((f * k) % 32) / 32)) AS im, 32 AS n FROM sig, range(32) q(f) GROUP BY stroke_id, f",
    "psd": "SELECT *, re*re + im*im AS power FROM pow",
    "cs": "SELECT d.doc_id AS id, d.lang AS label, d.source AS source_type, l.quality::DOUBLE AS quality_score, l.toxic = 0 AS is_validated, n_chars AS n_points FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "cm": "SELECT o_orderkey AS id, o_orderpriority AS name, o_orderdate AS created_at, o_totalprice AS validation_accuracy, o_orderstatus = 'O' AS is_active, o_custkey AS owner FROM orders",
    "pr": "SELECT id, target, p, (list_position(p, list_max(p)) - 1)::INT AS predicted FROM (SELECT vec_id AS id, label AS target, list_transform(e, lambda v: v / list_sum(e)) AS p FROM (SELECT vec_id, label, list_transform(embedding[1:10], lambda v: exp(v::DOUBLE)) AS e FROM embeddings))",
}
_NEEDS = {"box": ["pts"], "stp": [], "cur": ["stp"], "rob": ["cur"], "strokes": ["pts"], "pairs": [], "seg": [], "sp": ["seg"], "sig": ["stp"], "pow": ["sig"], "psd": ["pow"]}


def sql_form(body: str, uses: str, points: str) -> str:
    names: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if "{points}" in COMMON[name]:
            add(points)
        if name not in names:
            names.append(name)

    for name in uses.split():
        add(name)
    tables = ",\n".join(f"{n} AS ({COMMON[n].replace('{points}', points)})" for n in names)
    body = body.lstrip()
    if body.startswith("WITH "):
        return f"WITH RECURSIVE {tables},\n{body[5:]}"
    return f"WITH {tables}\n{body}"


def over(name: str, points: str) -> str:
    """The SQL form of another query over the common table ``points``, as a subquery."""
    return f"({sql_form(*BODIES[name], points)})"


def unrounded(name: str, points: str) -> str:
    """The same without its roundings, for forms that go on from it."""
    body, uses = BODIES[name]
    plain = re.sub(r"round\(([^\n]*?), \d\) \+ 0\.0 AS", r"(\1) AS", body)
    return f"({sql_form(plain, uses, points)})"


def query(name: str, sql: str | None = None, uses: str = "", points: str = "pts") -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql_form(sql, uses, points) if uses else sql
            BODIES[name] = (sql, uses)
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles, and arrays of them, rounded, without negative zeros; other columns as they are."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "double":
            out[name] = F.round(name, places) + F.lit(0.0)
        elif kind == "array<double>":
            out[name] = F.transform(name, lambda v: F.round(v, places) + F.lit(0.0))
    return df.withColumns(out)
