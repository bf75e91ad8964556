"""Layout against a plain run; tables that change in part; imports and analyses that survive restarts."""

from __future__ import annotations

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_images_and_loops import png

from quillspark.operators import analysis, embedding, extra, layout
from quillspark.sources import mutations
from quillspark.streaming import imports, live, progress, strokes


def draw(*keys):
    return (int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:12], 16) + 0.5) / 2**48


def plain_layout(edges, places, epochs, spread=1.0, rate=1.0, seed=42):
    e, n = places.copy(), len(places)
    for epoch in range(epochs):
        force = np.zeros_like(e)
        for i, j, w in edges:
            d = e[j] - e[i]
            force[i] += w * max(0.0, 1 - math.sqrt(d @ d) / spread) * d * rate
        for i in range(n):
            for s in range(5):
                j = math.floor(draw(seed, epoch, i, s) * n)
                if j != i:
                    d = e[i] - e[j]
                    force[i] += 1 / (1 + d @ d / spread) * d * rate * 0.5
        e += force
        if epoch > epochs / 2:
            rate *= 0.99
    return e


def test_layout_equals_a_plain_run(spark):
    rng = np.random.default_rng(2)
    n, epochs = 300, 8
    places = rng.random((n, 3)) * 4
    edges = [(i, int(j), float(w)) for i in range(n) for j, w in zip(rng.choice(n, 6, replace=False), rng.random(6)) if i != j]
    graph = spark.createDataFrame(edges, "id long, other long, weight double")
    start = spark.createDataFrame([(k, k, p.tolist()) for k, p in enumerate(places)], "id long, number long, place array<double>")
    found = {r.id: r.place for r in layout.laid_out(graph, start, epochs).collect()}
    assert np.allclose([found[k] for k in range(n)], plain_layout(edges, places, epochs), atol=1e-9)
    again = {r.id: r.place for r in layout.laid_out(graph.repartition(3), start.repartition(2), epochs).collect()}
    assert again == found
    assert not layout.laid_out(graph, start.where("id < 0"), 3).collect()


def test_layout_lowers_the_stress(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.1, (20, 8)) for c in (-1, 1)])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    graph = embedding.symmetrised(embedding.fuzzy_weights(embedding.neighbours(rows, rows, 5), 5))
    start = rows.select("id", F.col("id").alias("number"), F.array(*(extra.initial_place(3 * F.col("id") + a + 1) for a in range(3))).alias("place"))
    done = layout.laid_out(graph, start, 30)
    stress = lambda p: embedding.stress(rows.join(p.select("id", F.col("place").alias("e")), "id")).first().stress
    # repulsion has no bound, so the whole grows; what it keeps is who lies near whom
    spread = lambda p: p.select(F.explode("place").alias("v")).agg(F.stddev("v")).first()[0]
    scaled = done.withColumn("place", F.transform("place", lambda v: v * F.lit(spread(start) / spread(done))))
    assert math.isfinite(stress(done)) and stress(scaled) < stress(start) * 1.5


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_changes_write_only_the_parts_they_touch(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "id long, name string, score double, updated_at timestamp"
    rows = spark.range(500).selectExpr("id", "'n' || id as name", "double(id) as score", "timestamp'2024-01-01' as updated_at")
    mutations.store(rows, path, "id", 16)
    with pytest.raises(Exception, match="(?i)exists"):
        mutations.store(rows, path, "id", 16)
    before = files_of(tmp_path)
    changes = spark.createDataFrame([(7, "seven", 1), (9999, "none", 2), (None, "null", 3)], "id long, name string, unknown int")
    mutations.update(changes, path, rows.schema, "id", F.expr("timestamp'2025-01-01'"), parts=16)
    after = files_of(tmp_path)
    kept = before.keys() & after.keys()
    assert len({os.path.dirname(f) for f in before.keys() - after.keys()}) <= 3 and all(before[f] == after[f] for f in kept) and kept
    expected = {r.id: tuple(r) for r in rows.collect()}
    expected[7] = (7, "seven", 7.0, expected[7][3].replace(year=2025))
    read = lambda: {r.id: tuple(r) for r in mutations.load(spark, path, rows.schema).collect()}
    assert read() == expected
    assert mutations.delete(spark.createDataFrame([(8,), (8,), (-1,), (None,)], "id long"), path, rows.schema, "id", 16) == 1
    assert mutations.delete(spark.createDataFrame([(8,)], "id long"), path, rows.schema, "id", 16) == 0
    mutations.append(spark.createDataFrame([(1000, "new", 0.5)], "id long, name string, score double"), path, "id", 16)
    del expected[8]
    expected[1000] = (1000, "new", 0.5, None)
    assert read() == expected
    # a part whose rows all go
    part = {r.id for r in rows.where(f"pmod(xxhash64(string(id)), 16) = {spark.sql('select pmod(xxhash64(string(1L)), 16)').first()[0]}").collect()}
    gone = part & expected.keys()
    assert mutations.delete(spark.createDataFrame([(k,) for k in gone], "id long"), path, rows.schema, "id", 16) == len(gone)
    assert read() == {k: v for k, v in expected.items() if k not in gone} and schema


def write_images(folder, names):
    folder.mkdir(parents=True, exist_ok=True)
    for k, name in enumerate(names):
        image = np.full((40, 40), 255, np.uint8)
        image[5:35, 10 + k : 13 + k] = 0
        (folder / name).write_bytes(png(image, [0] * 40) if name.endswith("png") else b"no image")


def test_imports_take_each_file_once(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", f"file://{tmp_path}/out"
    write_images(source / "G", ["a.png", "b.png", "note.txt", "broken.bmp"])
    with pytest.raises(ValueError, match="does not exist"):
        imports.import_files(spark, f"file://{tmp_path}/nowhere", target, "one")
    first = imports.import_files(spark, f"file://{source}", target, "one", per_batch=2).first()
    assert (first.total_files, first.processed_files, first.failed_files, first.success_rate) == (4, 2, 2, 50.0)
    rows = {r.image_id.rsplit("/", 1)[-1]: r for r in imports.imported(spark, target, "files").collect()}
    assert rows["note.txt"].error == "Unsupported file type: note.txt" and rows["broken.bmp"].status == "failed" and rows["a.png"].label == "G"
    made = imports.imported(spark, target, "strokes")
    assert made.count() == first.created_stroke_records == sum(r.n_strokes for r in rows.values() if r.status == "processed") > 0
    # more files, and a writer that fails after the strokes of the batch were written: the batch is done again
    write_images(source / "H", ["c.png", "d.png"])
    real = imports.records.of_labels
    calls = []

    def failing(files, labels):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(files, labels)

    monkeypatch.setattr(imports.records, "of_labels", failing)
    with pytest.raises(Exception, match="killed"):
        imports.import_files(spark, f"file://{source}", target, "one", per_batch=1)
    monkeypatch.undo()
    last = imports.import_files(spark, f"file://{source}", target, "one", per_batch=1).first()
    assert (last.total_files, last.processed_files, last.failed_files) == (6, 4, 2)
    assert made.sparkSession.read.parquet(f"{target}/strokes").count() == last.created_stroke_records
    # another name imports anew, and only the labels asked for
    other = imports.import_files(spark, f"file://{source}", target, "two", labels=["h"]).first()
    assert (other.total_files, other.processed_files) == (2, 2)


def test_progress_survives_restarts(spark, tmp_path):
    told, folder = [], f"file://{tmp_path}/ledger"
    batch = lambda good, bad: spark.createDataFrame([("processed",)] * good + [("failed",)] * bad, "status string")
    take = lambda: progress.told_once(folder, lambda *x: told.append(x))
    take()(batch(6, 2), 0)
    take()(batch(6, 2), 1)  # a new process
    take()(batch(6, 2), 1)  # the same batch again
    take()(batch(1, 0), 2)
    take()(batch(4, 0), 3)
    assert told == [(12, 4), (17, 4)]


def test_growing_strokes_are_analysed_as_batches_are(spark, tmp_path):
    rng = np.random.default_rng(1)
    parts = ("preprocessing", "curvature")
    points = [(k % 2, "L", float(x), float(y), 10.0 * k, None, k) for k, (x, y) in enumerate(rng.random((48, 2)))]
    points[30], points[40] = points[40], points[30]  # one of the first stroke comes late, one early
    schema = "stroke_id long, label string, x double, y double, time double, pressure double, ts timestamp"
    source, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    sofar = []
    for low in (0, 16, 32):
        some = points[low : low + 16] + points[low : low + 1]  # a point told twice
        df = spark.createDataFrame(some, schema.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = strokes.point_stream(spark, source, df.schema)
        # each time a new run that goes on from the checkpoint
        strokes.run_available(live.prefixes(stream), live.analysis_sink(spark, out, parts), str(tmp_path / "c"))
        sofar += points[low : low + 16]
        long = []
        for stroke in (0, 1):
            own = sorted((p for p in sofar if p[0] == stroke), key=lambda p: p[4])
            long += [(stroke, "L", i, *p[2:6]) for i, p in enumerate(own)] if len(own) > live.LEAST else []
        if not long:
            continue
        whole = spark.createDataFrame(long, "stroke_id long, label string, i int, x double, y double, time double, pressure double")
        expected = {r.stroke_id: r for r in analysis.analyse(whole, parts).collect()}
        found = {r.stroke_id: r for r in live.latest(spark, out).collect()}
        assert found.keys() == expected.keys()
        for k, r in found.items():
            assert r.n == expected[k].n and [v for v in r if isinstance(v, float)] == pytest.approx([v for v in expected[k] if isinstance(v, float)], nan_ok=True)


def test_analysis_of_a_stored_stroke_gives_one_row(spark, tmp_path):
    # a plan whose unions claim a partitioning that they lack once gave two
    rng = np.random.default_rng(1)
    rows = [(0, "L", i, float(x), float(y), 10.0 * i, None) for i, (x, y) in enumerate(rng.random((16, 2)))]
    points = spark.createDataFrame(rows, "stroke_id long, label string, i int, x double, y double, time double, pressure double").coalesce(1)
    points.write.parquet(str(tmp_path / "p"))
    found = analysis.analyse(spark.read.parquet(str(tmp_path / "p")), ("preprocessing", "curvature")).collect()
    assert [r.n_landmarks for r in found] == [9]
