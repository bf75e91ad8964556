from __future__ import annotations

import math

import pytest

from quillspark.operators import geometry, pairs, sequence, signature, topology, validation
from quillspark.schema import to_long, to_nested

STROKES = {
    "square": [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)],
    "line": [(0, 0), (1 / 3, 0), (2 / 3, 0), (1, 0)],
    "bowtie5": [(0, 0), (1, 1), (1, 0), (0, 1), (0, 0.5)],
    "bowtie4": [(0, 0), (1, 1), (1, 0), (0, 1)],
    "duplicate": [(0, 0), (0, 0), (1, 0), (1, 1)],
    "single": [(0.5, 0.5)],
}


@pytest.fixture(scope="module")
def points(spark):
    rows = [(name, "L", i, float(x), float(y), 10.0 * i) for name, p in STROKES.items() for i, (x, y) in enumerate(p)]
    return spark.createDataFrame(rows, "stroke_id string, label string, i int, x double, y double, time double")


def by_stroke(df, column):
    return {r["stroke_id"]: r[column] for r in df.collect()}


def test_turning_and_winding(points):
    turning = by_stroke(sequence.total_turning(points), "total_turning")
    assert turning["square"] == pytest.approx(3 * math.pi / 2)
    assert turning["bowtie5"] == pytest.approx(7.068583, abs=1e-6)
    assert turning["single"] == 0
    winding = by_stroke(sequence.origin_winding(points), "winding")
    assert winding["bowtie5"] == pytest.approx(0.25)
    assert winding["single"] == 0


def test_turn_curvature(points):
    rows = sequence.turn_curvature(points).where("curvature is not null").orderBy("i").collect()
    values = {name: [r.curvature for r in rows if r.stroke_id == name] for name in STROKES}
    assert values["square"] == pytest.approx([1, 1, 1])
    assert values["bowtie5"] == pytest.approx([-math.sqrt(0.5), -math.sqrt(0.5), math.sqrt(0.5)])
    assert values["duplicate"] == pytest.approx([0, 1])
    assert values["single"] == []


def test_crossings_and_writhe(points):
    found = pairs.crossings(points).collect()
    assert [(r.stroke_id, r.s, r.t, round(r.cx, 6), round(r.cy, 6), r.sign) for r in found] == [("bowtie5", 0, 2, 0.5, 0.5, 1)]
    writhe = by_stroke(pairs.writhe(points), "writhe")
    assert writhe["bowtie5"] == pytest.approx(0.125)
    assert writhe["bowtie4"] == writhe["line"] == writhe["single"] == 0


def test_signature_levels(points):
    found = {r.stroke_id: r for r in signature.levels(signature.normalised(points)).collect()}
    assert (found["line"].s_x, found["line"].s_y) == pytest.approx((1, 0))
    assert (found["square"].s_xy, found["square"].s_yx) == pytest.approx((0.0625, -0.0625))
    assert found["bowtie5"].s_xy == pytest.approx(-0.010675, abs=1e-6)
    assert found["single"].s_xx == 0


def test_symmetry_loops_and_pieces(points):
    symmetry = by_stroke(geometry.symmetry(points), "symmetry")
    assert symmetry["square"] == pytest.approx(1)
    assert symmetry["bowtie5"] == pytest.approx(0.801348, abs=1e-6)
    assert symmetry["single"] == 0
    assert by_stroke(pairs.loop_signature(points), "loops")["square"] == [0.8]
    merged = topology.betti_zero(topology.merge_distances(points))
    assert by_stroke(merged, "b0")["square"] == 4
    assert by_stroke(merged, "persistence")["square"] == 0


def test_checks_and_shapes_of_rows(spark, points):
    broken = spark.createDataFrame([("n", 0, float("nan"), 0.0, 0.0, 0.5), ("n", 1, 1.0, 1.0, 5.0, 2.0), ("n", 2, 1.0, 1.0, 4.0, None)], "stroke_id string, i int, x double, y double, time double, pressure double")
    row = validation.check_strokes(broken).first()
    assert (row.n_points, row.n_errors, row.n_warnings, row.is_valid) == (3, 2, 1, False)
    from pyspark.sql import functions as F

    nested = to_nested(points.withColumn("pressure", F.lit(None).cast("double")))
    assert to_long(nested, "stroke_id").count() == points.count()


def test_empty_input(spark, points):
    none = points.where("false")
    for df in (sequence.arc_length(none), sequence.curvature_metrics(none), sequence.affine_metrics(none), signature.levels(none), pairs.crossings(none), topology.merge_distances(none), geometry.resample(none, 8)):
        assert df.count() == 0


def test_resampling_keeps_still_strokes_and_pressure(spark):
    still = [("still", k, 1.0, 2.0, 10.0 * k, 0.5) for k in range(20)]
    line = [("line", k, float(k), 0.0, 10.0 * k, [0.2, None, 0.0, 0.8][k % 4]) for k in range(9)]
    few = [("few", 0, 3.0, 4.0, 0.0, None)]
    points = spark.createDataFrame(still + line + few, "stroke_id string, i int, x double, y double, time double, pressure double")
    found = {}
    for r in geometry.resample(points, 5).collect():
        found.setdefault(r.stroke_id, {})[r.k] = (r.x, r.y, r.time, r.pressure)
    assert found["still"] == {k: (1.0, 2.0, 0.0 if k < 4 else 190.0, 0.5) for k in range(5)}
    # each wanted place ends a segment: the second of a pair, whose missing pressure counts as 1
    assert found["line"] == {0: (0.0, 0.0, 0.0, 0.2), 1: (2.0, 0.0, 20.0, None), 2: (4.0, 0.0, 40.0, pytest.approx(0.2)), 3: (6.0, 0.0, 60.0, None), 4: (8.0, 0.0, 80.0, 0.2)}
    assert found["few"] == {0: (3.0, 4.0, 0.0, None)}
    assert geometry.resample(points.drop("pressure"), 5).columns == ["stroke_id", "k", "x", "y", "time"]


def test_triangles_equal_all_triples_tried():
    """Random points, grids, circles, lines, repeated points, none at all."""
    import itertools

    import numpy as np

    from quillspark.operators import triangulation as A

    draw, turn = np.random.default_rng(1), np.linspace(0, 2 * np.pi, 13)[:-1]
    cases = [draw.uniform(size=(n, 2)) for n in (0, 1, 2, 3, 8, 20)] + [draw.integers(0, 5, size=(n, 2)).astype(float) for n in (4, 9, 18, 22)]
    cases += [np.stack([np.cos(turn), np.sin(turn)], 1), np.stack([np.arange(9.0), np.arange(9.0) * 2], 1), np.ones((5, 2))]
    cases.append(np.stack(np.meshgrid(np.arange(4) / 7, np.arange(5) / 3), -1).reshape(-1, 2))
    for points in cases:
        x, y = points[:, 0].copy(), points[:, 1].copy()
        expected = []
        for a, b, c in itertools.combinations(range(len(x)), 3):
            if abs((x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a])) / 2 > A.LEAST_AREA:
                cx, cy, r = A.circle(x, y, a, b, c)
                away = np.sqrt((x - cx) ** 2 + (y - cy) ** 2)
                away[[a, b, c]] = np.inf
                if not (away < r - A.SLACK).any():
                    expected.append((a, b, c))
        assert A.empty_triangles(x, y) == expected
    long = draw.uniform(size=(5000, 2))
    found = A.empty_triangles(long[:, 0].copy(), long[:, 1].copy())
    assert 2 * 5000 - 100 < len(found) < 2 * 5000  # 2 n - 2 less the points on the hull
