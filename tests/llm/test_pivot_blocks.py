from __future__ import annotations

import os

import numpy as np

from quillspark.llm import pivot_join
from quillspark.llm.shared import scratch_dir


def bytes_in(folder):
    return sum(os.path.getsize(os.path.join(top, f)) for top, _, files in os.walk(folder) for f in files)


def test_vectors_are_stored_once_for_a_step(spark, monkeypatch):
    monkeypatch.setattr(pivot_join, "CELL", 20)
    x = np.random.default_rng(7).normal(size=(2000, 64))
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.tolist())], "vec_id long, label int, embedding array<double>")
    folder = scratch_dir(spark).removeprefix("file://")
    before = bytes_in(folder)
    assert pivot_join.near_vectors(df).where("n_links > 0").count() == 0
    # two tables of the vectors, and ids
    assert bytes_in(folder) - before < 4 * x.nbytes


def test_blocks_of_many_labels_and_lengths_equal_brute_force(spark, monkeypatch):
    for name, value in (("CELL", 8), ("BLOCK", 16), ("ARRANGED", 64), ("PART", 1000)):
        monkeypatch.setattr(pivot_join, name, value)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        label, size = int(rng.integers(0, 9)), (3, 5)[int(rng.integers(0, 2))]
        rows.append((i, label if label else 100, [float(v) for v in rng.normal(size=size).round(1 if i % 2 else 6)]))
    rows += [(1000 + k, r[1], r[2]) for k, r in enumerate(rows[:50])]  # exact copies
    linked = np.zeros((len(rows), len(rows)), bool)
    for a, (_, la, va) in enumerate(rows):
        for b, (_, lb, vb) in enumerate(rows):
            if a != b and la == lb and len(va) == len(vb):
                linked[a, b] = np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb) >= 0.93 or va == vb
    least = [r[0] for r in rows]
    changed = True
    while changed:
        new = [min([least[a], *(least[b] for b in np.flatnonzero(linked[a]))]) for a in range(len(rows))]
        changed, least = new != least, new
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in pivot_join.near_vectors(df).collect()}
    assert found == {r[0]: (int(linked[a].sum()), least[a]) for a, r in enumerate(rows)}


def test_cosines_at_the_threshold_are_decided_in_double_precision():
    a = np.array([[1.0, 0.0]])
    angles = np.arccos(0.93) + np.array([-1e-3, -1e-9, 1e-9, 1e-3])
    b = np.c_[np.cos(angles), np.sin(angles)]
    one, other = (pivot_join._Block.__new__(pivot_join._Block) for _ in "ab")
    one.unit, other.unit, one.single, other.single = a, b, a.astype(np.float32), b.astype(np.float32)
    assert pivot_join.linked_pairs(one, other, slice(0, 1), slice(0, 4), 0.93).tolist() == [[True, True, False, False]]
