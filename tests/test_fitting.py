"""Training, projection and crossings against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from quillspark.operators import fitting as T
from quillspark.operators.pairs import crossings, in_cells, segments
from quillspark.operators.projection import projected


def table(spark, x, labels, parts):
    rows = [(k, v.tolist(), label, part) for k, (v, label, part) in enumerate(zip(x, labels, parts))]
    return spark.createDataFrame(rows, "id long, features array<double>, label string, part string").repartition(3)


def clouds(n=240):
    draw = np.random.default_rng(5)
    code = np.arange(n) % 3
    x = draw.normal(size=(n, 4)) + np.eye(4)[code] * 3
    parts = np.where(np.arange(n) % 5 == 4, "validation", "train")
    return x, code, parts


def loss_of(vector, sizes, x, code):
    return T.sums(T.shaped(vector, sizes), x, code, False)[1]


def test_gradient_equals_differences():
    x, code, _ = clouds(12)
    sizes = [4, 5, 3]
    at = T.flat(T.initial(sizes, 1))
    found = T.sums(T.shaped(at, sizes), x, code)[3:]
    for k in range(len(at)):
        step = np.zeros(len(at))
        step[k] = 1e-6
        assert abs((loss_of(at + step, sizes, x, code) - loss_of(at - step, sizes, x, code)) / 2e-6 - found[k]) < 1e-4


@pytest.mark.parametrize("kind", ["adam", "adamw", "sgd"])
def test_training_equals_one_machine(spark, kind):
    x, code, parts = clouds()
    settings = T.Settings(hidden=(6,), epochs=5, rate=0.05, optimiser=kind, schedule="step", schedule_patience=2)
    model = T.fitted(table(spark, x, [f"c{k}" for k in code], parts), settings=settings)
    at, learn = T.flat(T.initial([4, 6, 3], settings.seed)), parts == "train"
    m = v = np.zeros(len(at))
    for epoch in range(1, 6):
        rate = 0.05 * 0.5 ** ((epoch - 1) // 2)
        one = T.sums(T.shaped(at, [4, 6, 3]), x[learn], code[learn])
        g = one[3:] / one[0]
        before = at
        if kind == "adamw":
            at = at - rate * 1e-4 * at
        else:
            g = g + 1e-4 * at
        if kind == "sgd":
            m = 0.9 * m + g
            at = at - rate * m
        else:
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            at = at - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        row = model.epochs[epoch - 1]
        assert abs(row[1] - one[1] / one[0]) < 1e-9 and abs(row[5] - rate) < 1e-12
        assert abs(row[3] - loss_of(at, [4, 6, 3], x[~learn], code[~learn]) / (~learn).sum()) < 1e-9
        assert not np.array_equal(before, at)


def test_steps_learn_and_predict(spark):
    x, code, parts = clouds()
    rows = table(spark, x, [f"c{k}" for k in code], parts)
    model = T.fitted(rows, settings=T.Settings(epochs=15, steps=3, rate=0.1))
    assert max(e[4] for e in model.epochs) > 0.85
    found = T.predicted(rows, model).toPandas()
    assert len(found) == 240 and (found.target == found.predicted).mean() > 0.85
    assert np.allclose([sum(p) for p in found.p], 1)
    assert model.history(spark).count() == len(model.epochs)


def test_early_stop_and_plateau(spark):
    x, code, parts = clouds(60)
    model = T.fitted(table(spark, x, ["one"] * 60, parts), settings=T.Settings(epochs=9, patience=3, schedule_patience=1))
    assert [e[6] for e in model.epochs] == [0, 1, 2, 3]  # one class is always right, so no epoch is better than the first
    assert [e[5] for e in model.epochs] == [0.001, 0.001, 0.001, 0.0005]


def test_edges(spark):
    x, code, parts = clouds(30)
    rows = table(spark, x, [None if k == 3 else "a" if k % 2 else "b" for k in range(30)], np.array(["train"] * 30))
    broken = spark.createDataFrame([(90, [None] * 4, "z", "train"), (91, [float("nan")] * 4, "z", "train"), (92, None, "z", "train")], rows.schema)
    model = T.fitted(rows.unionByName(broken), settings=T.Settings(epochs=2))
    assert T.predicted(rows.unionByName(broken), model).count() == 30
    assert model.labels == ["a", "b"] and [e[3:5] for e in model.epochs] == [(None, None)] * 2
    assert T.predicted(rows, model).where("target is null").count() == 1
    for wrong in (rows.where("false"), rows.unionByName(spark.createDataFrame([(99, [1.0], "a", "train")], rows.schema))):
        with pytest.raises(ValueError):
            T.fitted(wrong)
    with pytest.raises(ValueError):
        T.Schedule(T.Settings(schedule="daily"))
    with pytest.raises(ValueError):
        T.Optimiser("none", 1, 0, 0)


def test_projection_equals_numpy(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(120, 6)) @ draw.normal(size=(6, 6)) + 5
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(200, None), (201, [float("nan")] * 6), (202, [None] * 6)]
    places, shares = projected(spark.createDataFrame(rows, "id long, features array<double>"))
    values, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    found = places.orderBy("id").toPandas()
    assert len(found) == 120
    assert np.allclose(np.stack(found.place), (x - x.mean(axis=0)) @ axes, atol=1e-8)
    assert np.allclose([r.share for r in shares.orderBy("axis").collect()], values[::-1][:2] / values.sum())
    empty = spark.createDataFrame([], "id long, features array<double>")
    assert projected(empty)[0].count() == 0 and projected(empty)[1].count() == 0
    with pytest.raises(ValueError):
        projected(spark.createDataFrame(rows, "id long, features array<double>"), count=9)


def test_crossings_of_long_strokes(spark):
    draw = np.random.default_rng(8)
    n = 1500
    strokes = [np.cumsum(draw.normal(size=(n, 2)), axis=0), draw.uniform(size=(300, 2)), np.stack([np.arange(200) % 7, np.arange(200) % 5], axis=1) * 1.0]
    strokes.append(np.full((40, 2), 2.0))
    rows = [(k, i, float(x), float(y)) for k, stroke in enumerate(strokes) for i, (x, y) in enumerate(stroke)]
    points = spark.createDataFrame(rows, "stroke_id long, i int, x double, y double")
    found = {(r.stroke_id, r.s, r.t): (r.cx, r.cy) for r in crossings(points).collect()}
    expected = {}
    for k, p in enumerate(strokes):
        v = np.diff(p, axis=0)
        for s in range(len(v)):
            t = np.arange(s + 2, len(v) - (s == 0))
            den = v[s, 0] * v[t, 1] - v[s, 1] * v[t, 0]
            with np.errstate(all="ignore"):
                gx, gy = p[t, 0] - p[s, 0], p[t, 1] - p[s, 1]
                along, across = (gx * v[t, 1] - gy * v[t, 0]) / den, (gx * v[s, 1] - gy * v[s, 0]) / den
            hit = (np.abs(den) >= 1e-10) & (along >= 0) & (along <= 1) & (across >= 0) & (across <= 1)
            expected |= {(k, s, int(j)): tuple(p[s] + a * v[s]) for j, a in zip(t[hit], along[hit])}
    assert found.keys() == expected.keys() and len(expected) > 1000
    assert all(np.allclose(found[key], expected[key]) for key in found)
    walk = in_cells(segments(points.where("stroke_id = 0"))).groupBy("cell").count().collect()
    assert sum(r["count"] ** 2 for r in walk) < n * n / 8
