from __future__ import annotations

import math

import numpy as np
import pytest

from quillspark.operators import blocks, embedding, layout

KINDS = ("euclidean", "manhattan", "cosine")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nearest(ids, x, k, kind):
    """By every distance on its own."""
    out = {}
    for i, q in zip(ids, x):
        with np.errstate(all="ignore"):
            d = embedding.apart(x, q, kind)
        good = (ids != i) & ~np.isnan(d)
        order = np.lexsort((ids[good], d[good]))[:k]
        out.setdefault(i, list(zip(ids[good][order].tolist(), d[good][order].tolist())))
    return out


def tables():
    rng = np.random.default_rng(3)
    normal = rng.normal(size=(700, 16))
    odd = normal[:300].copy()
    odd[3, 2], odd[7], odd[9, 1] = np.nan, np.inf, -np.inf
    return {"normal": normal, "far": normal + 1e6, "small": normal[:3], "one": normal[:1], "copies": np.tile(normal[:60], (9, 1)), "equal": np.zeros((300, 4)), "ties": rng.integers(0, 3, size=(600, 3)).astype(float), "odd": odd, "tiny": normal[:200] * 1e-200, "huge": normal[:200] * 1e200}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("name", sorted(tables()))
def test_nearest_of_blocks_equals_every_distance(name, kind):
    x = tables()[name]
    if kind == "cosine" and name in ("tiny", "huge"):
        return
    ids = np.arange(len(x))
    found = blocks.Nearest(ids, x, 5, kind)
    for part in np.array_split(ids, 3):
        found.add(part, x[part])
    got = {i: list(zip(found.other[found.row == i].tolist(), found.d[found.row == i].tolist())) for i in ids}
    assert got == nearest(ids, x, 5, kind)


def test_rows_with_equal_ids_are_no_neighbours():
    ids, x = np.arange(300) // 20, np.random.default_rng(1).normal(size=(300, 6))
    found = blocks.Nearest(ids, x, 5, "euclidean")
    found.add(ids, x)
    assert all((found.other[found.row == i] != ids[i]).all() and (found.row == i).sum() == 5 for i in range(300))


def frame(spark, x, **more):
    return spark.createDataFrame([(i, [float(c) for c in v], *(e[i] for e in more.values())) for i, v in enumerate(x)], "id long, v array<double>" + "".join(f", {c} array<double>" for c in more))


@pytest.mark.parametrize("kind", KINDS)
def test_neighbours_over_several_parts(spark, monkeypatch, kind):
    monkeypatch.setattr(blocks, "PART", 10_000)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 0)
    x = tables()["normal"]
    rows = frame(spark, x).repartition(3)
    got = {}
    for r in embedding.neighbours(rows, rows.where("id % 7 = 0"), 4, kind).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.other, r.d))
    want = nearest(np.arange(len(x)), x, 4, kind)
    assert got == {i: want[i] for i in range(0, len(x), 7)}


def test_neighbours_of_few_rows(spark):
    rows = frame(spark, [[0.0, 0.0], [1.0, 0.0]])
    assert [(r.id, r.other, r.d) for r in embedding.neighbours(rows, rows, 5).orderBy("id").collect()] == [(0, 1, 1.0), (1, 0, 1.0)]
    assert embedding.neighbours(rows.where("false"), rows, 5).count() == embedding.neighbours(rows, rows.where("false"), 5).count() == 0


def test_rows_are_stored_once_for_a_side_and_graphs_worked_out_once(spark):
    rows = frame(spark, tables()["normal"])
    near = embedding.neighbours(rows, rows, 5)
    for df, products in ((near, 1), (embedding.symmetrised(embedding.fuzzy_weights(near, 5)), 1), (embedding.overlap(near, embedding.neighbours(rows, rows, 5, "manhattan"), 5), 2)):
        assert plan(df).count("CartesianProduct") == products
        assert "FlatMapGroups" not in plan(df) and "sequence" not in plan(near)


@pytest.mark.parametrize("name", ["normal", "far", "small", "one", "copies", "equal"])
def test_stress_equals_every_pair(spark, name):
    x = tables()[name]
    e = x[:, :3] * 0.5
    i, j = np.triu_indices(len(x), 1)
    d, f = (np.sqrt(((m[i] - m[j]) ** 2).sum(axis=1)) for m in (x, e))
    total = (d * d).sum()
    want = math.sqrt(((d - f) ** 2).sum() / total) if total > 0 else 0.0
    rows = frame(spark, x, e=[[float(c) for c in v] for v in e]).repartition(3)
    found = embedding.stress(rows, block=100)
    assert found.first().stress == pytest.approx(want, abs=1e-7)


def test_stress_leaves_out_pairs_with_equal_ids():
    x = np.random.default_rng(2).normal(size=(60, 4))
    ids = np.arange(60) % 40
    total = sum(blocks.differences(ids[a], ids[b], [x[a], x[b]], [x[a], x[b] * 0], a == b)[0] for a, b in ((slice(0, 30), slice(0, 30)), (slice(0, 30), slice(30, 60)), (slice(30, 60), slice(30, 60))))
    i, j = np.triu_indices(60, 1)
    assert total == pytest.approx((((x[i] - x[j]) ** 2).sum(axis=1) * (ids[i] != ids[j])).sum())


def test_overlap_counts_rows_without_common_neighbours(spark):
    graph = lambda edges: spark.createDataFrame(edges, "id long, other long")
    first, second = graph([(1, 2), (1, 3), (2, 1), (2, 3)]), graph([(1, 2), (1, 4), (2, 4), (2, 5), (9, 1)])
    assert embedding.overlap(first, second, 2).first().overlap == 0.25


def test_layout_sends_few_places_and_joins_many(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5), (1, 2, 0.25)], "id long, far long, weight double")
    places = spark.createDataFrame([(k, k, [float(k), 0.0, 1.0], 0) for k in range(3)], "id long, number long, place array<double>, epoch int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = lambda: layout.step(edges, places, 3, 10, 1.0, 1.0, 42)
        sent = step()
        assert plan(sent).count("BroadcastHashJoin") == 2
        monkeypatch.setattr(layout, "SENT", 0)
        joined = step()
        assert plan(joined).count("SortMergeJoin") == 2
        assert sorted(sent.collect()) == sorted(joined.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
