"""Feature vectors of strokes and similarities of each with the stroke of the id before it; SQL forms in blocks of their own."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quillspark.operators import features as B
from quillspark.operators import geometry as G
from quillspark.operators import homology as H
from quillspark.operators import sequence as S
from quillspark.operators import signature as Z
from quillspark.operators import spectral as X
from quillspark.plans.analysis import AFFINE
from quillspark.plans.registry import query, rounded, unrounded
from quillspark.plans.strokes import _drawing, box, pts


def _next_to(metrics):
    """Each stroke's row beside that of the stroke with the id before it."""
    return B.paired(metrics, metrics.select("stroke_id", (F.col("stroke_id") - 1).alias("other"))).withColumnRenamed("other", "o_stroke_id")


LEVELS = f"lev AS {unrounded('sig_levels', 'pts')}"
WORDS3 = ["".join((a, b, c)) for a in "xy" for b in "xy" for c in "xy"]
TWO = ("s_xx", "s_xy", "s_yx", "s_yy")
LOG = ", ".join(["s_x", "s_y", "s_xx", "s_xy - 0.5 * s_x * s_y", "s_yx + 0.5 * s_x * s_y", "s_yy"] + [f"s_{w} + (1 / 12.0::DOUBLE) * {'s_x' if k < 4 else 's_y'} * {TWO[k % 2]}" for k, w in enumerate(WORDS3)])


@query("sig06_log_signature", f"WITH {LEVELS} SELECT stroke_id, list_transform([{LOG}], lambda v: round(v, 6) + 0.0) AS log_signature FROM lev")
def _(spark, sf_dir):
    return rounded(Z.log_signature(Z.levels(Z.normalised(pts(spark, sf_dir)))).select("stroke_id", "log_signature"))


@query("sig_compare", f"""WITH {LEVELS}, logs AS (SELECT stroke_id, [{LOG}] AS l FROM lev)
SELECT a.stroke_id, b.stroke_id AS other, round(abs(list_dot_product(a.l, b.l) / sqrt(list_dot_product(a.l, a.l) * list_dot_product(b.l, b.l))), 6) AS similarity
FROM logs a JOIN logs b ON b.stroke_id = a.stroke_id - 1""")
def _(spark, sf_dir):
    logs = Z.log_signature(Z.levels(Z.normalised(pts(spark, sf_dir)))).select("stroke_id", F.col("log_signature").alias("log"))
    both = B.paired(logs, logs.select("stroke_id", (F.col("stroke_id") - 1).alias("other")))
    return rounded(Z.compare(both.select("stroke_id", "other", F.col("log").alias("log_a"), F.col("o_log").alias("log_b"))).select("stroke_id", "other", "similarity"))


NORM = "sqrt(" + " + ".join(f"s_{w} * s_{w}" for w in ["x", "y", "xx", "xy", "yx", "yy", *WORDS3]) + ")"


@query("sig11_features", f"""WITH {LEVELS}, n AS (SELECT *, {NORM} AS norm FROM lev)
SELECT stroke_id, list_transform([sqrt(s_x * s_x + s_y * s_y), atan2(s_y, s_x), s_xy - s_yx, s_xx + s_yy, s_xxx, s_yyy, s_xxy + s_yyx, variation, norm, ln(1 + norm),
       CASE WHEN variation > 0 THEN norm / variation ELSE 0 END], lambda v: round(v, 6) + 0.0) AS features FROM n""")
def _(spark, sf_dir):
    return rounded(B.signature_features(Z.levels(Z.normalised(pts(spark, sf_dir)))))


KNOTS = f"""
knot AS (
  SELECT w.stroke_id, writhe, origin_winding AS winding, total_turning, (writhe + origin_winding) / 2 AS linking, entropy, n_crossings AS n, n_positive AS p, mean_angle
  FROM {unrounded('geo21_writhe', 'box')} w JOIN {unrounded('win19_turning_and_windings', 'box')} t USING (stroke_id)
  JOIN {unrounded('agg14_geometric_complexity', 'box').replace('FROM pts WINDOW', 'FROM box WINDOW')} e USING (stroke_id) JOIN {unrounded('geo23_knot_features', 'box')} k USING (stroke_id))"""


@query("geo23_knot_vector", f"""WITH {KNOTS}
SELECT stroke_id, list_transform([writhe, winding, total_turning, linking, entropy, 0, n, n, p, n - p, mean_angle, 2 * p - n], lambda v: round(v, 6) + 0.0) AS features FROM knot""", "box")
def _(spark, sf_dir):
    return rounded(B.knot_features(B.knot_metrics(box(spark, sf_dir))))


@query("geo23_knot_similarity", f"""WITH {KNOTS}
SELECT a.stroke_id, b.stroke_id AS o_stroke_id, round(greatest(0, least(1, 0.2 * (1 - abs(a.writhe - b.writhe) / 10) + 0.15 * (1 - abs(a.winding - b.winding) / 5)
       + 0.2 * (1 - abs(a.total_turning - b.total_turning) / (2 * pi())) + 0.15 * (1 - abs(a.entropy - b.entropy) / 10) + 0.15 + 0.15 * (1 - abs(a.n - b.n) / 10.0::DOUBLE))), 6) AS similarity
FROM knot a JOIN knot b ON b.stroke_id = a.stroke_id - 1""", "box")
def _(spark, sf_dir):
    rows = _next_to(B.knot_metrics(box(spark, sf_dir)))
    return rounded(rows.select("stroke_id", "o_stroke_id", B.knot_similarity().alias("similarity")))


@query("topo08_similarity")
def _(spark, sf_dir):
    rows = _next_to(H.metrics(box(spark, sf_dir)))
    return rounded(rows.select("stroke_id", "o_stroke_id", B.topology_similarity().alias("similarity")))


WAVE = f"""
wav AS {unrounded('spc09_wavelet_energy', 'pts')},
went AS (SELECT stroke_id, sum(CASE WHEN share > 0 THEN -(share / t) * log2(share / t) ELSE 0 END) AS entropy FROM (SELECT *, sum(share) OVER (PARTITION BY stroke_id) AS t FROM wav) GROUP BY 1)"""
MEL = ", ".join(f"({f}, {k}, {w!r}::DOUBLE)" for f, k, w in X.mel_weights(32))
CEPSTRUM = f"""
spec AS {unrounded('spc01_spectrum', 'pts')},
mel AS (SELECT * FROM (VALUES {MEL}) v(f, k, w)),
ene AS (SELECT stroke_id, f, sum(power * w) AS e FROM spec JOIN mel USING (k) GROUP BY 1, 2),
logs AS (SELECT s.stroke_id, q.f, ln(greatest(coalesce(e, 0), 1e-10)) AS l FROM (SELECT DISTINCT stroke_id FROM spec) s CROSS JOIN range(26) q(f) LEFT JOIN ene ON ene.stroke_id = s.stroke_id AND ene.f = q.f),
cep AS (SELECT stroke_id, c, sum(l * cos(pi() * c * (f + 0.5) / 26)) AS value FROM logs, range(13) r(c) GROUP BY 1, 2)"""


@query("spc10_wavelet_entropy", f"WITH {WAVE} SELECT stroke_id, round(entropy, 6) + 0.0 AS entropy FROM went")
def _(spark, sf_dir):
    return rounded(X.wavelet_entropy(X.haar(X.tangent_signal(pts(spark, sf_dir)))))


@query("spc11_mfcc", f"WITH {CEPSTRUM} SELECT stroke_id, c::INT AS c, round(value, 6) + 0.0 AS value FROM cep")
def _(spark, sf_dir):
    return rounded(X.mfcc(X.spectrum(X.tangent_signal(pts(spark, sf_dir))), 32))


SPECTRAL = f"""
{WAVE},
{CEPSTRUM},
mom AS {unrounded('spc04_moments', 'pts')},
dom AS (SELECT stroke_id, list(frequency ORDER BY place) AS dominant FROM {unrounded('spc08_dominant', 'pts')} GROUP BY 1),
met AS (
  SELECT m.stroke_id, centroid, rolloff, kurtosis, w.entropy, coalesce(dominant, []::DOUBLE[]) AS dominant, energy, mfcc, powers,
         0.2 * (centroid / 32 + rolloff + least(1, abs(kurtosis) / 10) + w.entropy + len(coalesce(dominant, []::DOUBLE[])) / 10.0::DOUBLE) AS complexity
  FROM mom m JOIN went w USING (stroke_id) LEFT JOIN dom USING (stroke_id)
  JOIN (SELECT stroke_id, list(share ORDER BY level) AS energy FROM wav GROUP BY 1) e USING (stroke_id)
  JOIN (SELECT stroke_id, list(value ORDER BY c) AS mfcc FROM cep GROUP BY 1) c USING (stroke_id)
  JOIN (SELECT stroke_id, list(power ORDER BY k) AS powers FROM spec GROUP BY 1) p USING (stroke_id))"""


@query("spc16_features", f"""WITH {SPECTRAL}
SELECT stroke_id, list_transform(list_resize(list_concat([centroid, rolloff, kurtosis, complexity, len(dominant)], list_resize(dominant, 5, 0), [entropy], energy[1:3], mfcc[1:8]), 25, 0), lambda v: round(v, 5) + 0.0) AS features FROM met""")
def _(spark, sf_dir):
    return rounded(B.spectral_features(B.spectral_metrics(pts(spark, sf_dir), 32)), 5)


@query("spc15_similarity", f"""WITH {SPECTRAL}
SELECT a.stroke_id, b.stroke_id AS o_stroke_id, round(0.6 * coalesce(list_dot_product(a.powers, b.powers) / nullif(sqrt(list_dot_product(a.powers, a.powers) * list_dot_product(b.powers, b.powers)), 0), 0)
       + 0.4 * exp(-sqrt(list_sum(list_transform(range(1, 14), lambda j: pow(a.mfcc[j] - b.mfcc[j], 2)))) / 10), 6) AS similarity
FROM met a JOIN met b ON b.stroke_id = a.stroke_id - 1""")
def _(spark, sf_dir):
    rows = _next_to(B.spectral_metrics(pts(spark, sf_dir), 32))
    return rounded(rows.select("stroke_id", "o_stroke_id", B.spectral_similarity().alias("similarity")))


@query("win25_affine_metrics", f"""WITH {AFFINE},
m AS (SELECT a.stroke_id, a.i, a.kappa, b.kappa AS mirror, a.n FROM (SELECT *, count(*) OVER (PARTITION BY stroke_id) AS n FROM kap) a JOIN kap b ON a.stroke_id = b.stroke_id AND b.i = a.n + 3 - a.i),
g AS (SELECT stroke_id, max(abs(kappa)) AS max_kappa, avg(abs(kappa)) AS mean_kappa, var_pop(abs(kappa)) AS var_kappa,
             coalesce(avg(CASE WHEN i - 2 < floor(n / 2.0::DOUBLE) THEN exp(-10 * abs(kappa - mirror)) END), 0) AS symmetry FROM m GROUP BY 1),
t AS (SELECT stroke_id, max(s) AS affine_length FROM arc GROUP BY 1)
SELECT stroke_id, round(affine_length, 5) AS affine_length, round(max_kappa / (1 + max_kappa), 6) AS max_kappa, round(mean_kappa / (1 + mean_kappa), 6) AS mean_kappa,
       round(symmetry, 6) AS symmetry, round(sqrt(var_kappa) / (mean_kappa + 1e-10), 6) AS complexity
FROM t JOIN g USING (stroke_id)""", "stp")
def _(spark, sf_dir):
    found = S.affine_metrics(pts(spark, sf_dir))
    tame = {c: F.col(c) / (1 + F.col(c)) for c in ("max_kappa", "mean_kappa")}
    return rounded(found.withColumns(tame).withColumn("affine_length", F.round("affine_length", 5)).select("stroke_id", "affine_length", "max_kappa", "mean_kappa", "symmetry", "complexity"))


SPATIAL = f"""
drw AS {unrounded('geo14_feature_vector', 'box')},
vel AS (
  SELECT *, ds / greatest(dt, 1) AS v, CASE WHEN ds IS NOT NULL THEN atan2(dy, dx) END AS ta, lead(dx) OVER w AS ndx, lead(dy) OVER w AS ndy, lead(ds) OVER w AS nds, max(i) OVER (PARTITION BY stroke_id) AS last
  FROM stp WINDOW w AS (PARTITION BY stroke_id ORDER BY i)),
place AS (
  SELECT stroke_id, i, 2 * (b * 5 + complexity * 0.5 + crossings / 10.0::DOUBLE * 0.3 + x * 2) AS sx, 2 * (y * 4 + least(coalesce(v, 0) * 1000, 2) + i / greatest(last, 1)::DOUBLE * 2 + regularity) AS sy,
         2 * ((sin(coalesce(ta, 0)) + 1) * 2 + spectral_centroid * 0.5 + symmetry * 2 + (x + y) * 0.5) AS sz
  FROM (SELECT *, CASE WHEN ds * nds > 0 THEN abs(dx * ndy - dy * ndx) / (ds * nds) ELSE 0 END AS b FROM vel) JOIN drw USING (stroke_id)),
spa AS (
  SELECT stroke_id, avg(sqrt(pow(sx - mx, 2) + pow(sy - my, 2) + pow(sz - mz, 2))) AS spread
  FROM (SELECT *, avg(sx) OVER s AS mx, avg(sy) OVER s AS my, avg(sz) OVER s AS mz FROM place WINDOW s AS (PARTITION BY stroke_id)) GROUP BY 1),
spm AS (SELECT stroke_id, spread, CASE WHEN spread > 0 THEN 10 / spread ELSE 0 END AS separation FROM spa)"""


def _spatial(spark, sf_dir):
    p = pts(spark, sf_dir)
    return G.spatial_metrics(G.spatial_signature(p, _drawing(G.unit_square(p))))


@query("geo15_spatial_signature", f"WITH {SPATIAL} SELECT stroke_id, round(spread, 6) AS spread, round(separation, 6) AS separation FROM spm", "stp box", "box")
def _(spark, sf_dir):
    return rounded(_spatial(spark, sf_dir))


@query("geo16_spatial_similarity", f"""WITH {SPATIAL}
SELECT a.stroke_id, b.stroke_id AS o_stroke_id, round(greatest(0, 1 - (0.3 * abs(a.separation - b.separation) + 0.3 * abs(a.spread - b.spread)) / 10), 6) AS similarity
FROM spm a JOIN spm b ON b.stroke_id = a.stroke_id - 1""", "stp box", "box")
def _(spark, sf_dir):
    rows = _next_to(_spatial(spark, sf_dir))
    return rounded(rows.select("stroke_id", "o_stroke_id", B.spatial_similarity().alias("similarity")))
