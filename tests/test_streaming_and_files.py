from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillspark.operators import features
from quillspark.schema import STROKE
from quillspark.sources import files, tables
from quillspark.streaming import strokes


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = strokes.windowed_counts(strokes.point_stream(spark, str(tmp_path / "in"), events.schema))
    strokes.run_available(stream, lambda df, _: seen.append({(r.start, r.event_type): r.n for r in df.collect()}), str(tmp_path / "c"), "complete")
    assert seen[-1] == {(r.start, r.event_type): r.n for r in strokes.windowed_counts(events).collect()}


def test_growing_strokes(spark, tmp_path):
    rows = spark.sql("select id % 3 as stroke_id, timestamp_seconds(id) as ts, cast(id as double) as x, 1.0d as y from range(30)")
    rows.write.parquet(str(tmp_path / "in"))
    last = {}
    strokes.run_available(strokes.growing_strokes(strokes.point_stream(spark, str(tmp_path / "in"), rows.schema)), lambda df, _: last.update({r.stroke_id: (r.n, r.max_x) for r in df.collect()}), str(tmp_path / "c"), "update")
    assert last == {0: (10, 27.0), 1: (10, 28.0), 2: (10, 29.0)}


def test_json_strokes_keep_the_corrupt(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "label": "G", "points": [{"x": 1, "y": 2, "time": 0}], "completed": true}')
    (tmp_path / "b.json").write_text('{"id": "2", "points": ')
    rows = {r.id: r for r in files.read_strokes_json(spark, str(tmp_path)).collect()}
    assert rows["1"].points[0].x == 1.0
    assert sum(r._corrupt_record is not None for r in rows.values()) == 1


def test_labels_of_paths(spark):
    paths = {"/d/G/x.png": "G", "/data/b.037.png": "B", "/data/__.png": "UNKNOWN", "/data/Q_caps.049.png": "Q"}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.label for r in df.withColumn("label", files.label_of_path(F.col("path"))).collect()} == paths


def test_written_strokes_are_read_back(spark, tmp_path):
    rows = [("1", [(1.0, 2.0, 0.0, 0.5), (3.0, 4.0, 10.0, None)], True, "#000", "G"), ("2", [], False, None, None)]
    strokes_in = spark.createDataFrame(rows, STROKE)
    files.write_json(strokes_in, str(tmp_path / "out"))
    back = files.read_strokes_json(spark, str(tmp_path / "out" / "*.json"))
    assert sorted(map(tuple, back.drop("_corrupt_record").collect())) == sorted(map(tuple, strokes_in.collect()))
    found = {json.loads(r.json)["id"]: json.loads(r.json) for r in files.export_json(strokes_in).collect()}
    assert found["1"]["points"][0] == {"x": 1.0, "y": 2.0, "time": 0.0, "pressure": 0.5}
    assert "label" not in found["2"] and found["2"]["points"] == []


def test_database_tables_are_read_in_ranges(spark):
    url, driver = "jdbc:derby:memory:strokes;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(-3, 40).selectExpr("id", "id * 2 as twice")
    rows.write.format("jdbc").options(url=url, dbtable="numbers", driver=driver).save()
    found = tables.from_database(spark, url, "numbers", "id", 0, 30, 4, driver)
    assert found.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))  # rows outside the bounds too


def test_stored_vector_pads_and_cuts_its_blocks(spark):
    kinds = ", ".join(f"{n} double" for n in ("arc_length", "total_turning", "winding", "writhe", "complexity", "regularity", "symmetry", "stability", "centroid", "bandwidth"))
    full = (*map(float, range(1, 11)), [0.1] * 12, [0.2] * 14, [0.3] * 13)
    empty = (None,) * 13
    frame = spark.createDataFrame([full, empty], f"{kinds}, level1 array<double>, log_signature array<double>, mfcc array<double>")
    one, none = (r[0] for r in frame.select(features.stored_vector()).collect())
    assert one == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, *[0.1] * 10, *[0.2] * 14, *[0.0] * 6, 9.0, 10.0, *[0.3] * 13]
    assert none == [0.0] * 53
