"""Tables of a catalog, and progress streams."""

from __future__ import annotations

from quillspark.sources import tables
from quillspark.streaming import progress, strokes


def test_tables_are_defined_filled_copied_and_dropped(spark, tmp_path):
    names = tables.define(spark, "t1_")
    assert names == tables.define(spark, "t1_") and len(names) == 4
    found = {(r.table, r.column): r.kind for r in tables.describe(spark, names).collect()}
    assert found["t1_sessions", "current_epoch"] == "int" and found["t1_strokes", "is_validated"] == "boolean"
    rows = spark.createDataFrame([("a", "running", "7", 1), ("b", "failed", None, 2)], "session_id string, status string, current_epoch string, unknown int")
    tables.append(rows, "t1_sessions")
    assert {(r.session_id, r.current_epoch, r.progress) for r in spark.table("t1_sessions").collect()} == {("a", 7, None), ("b", None, None)}
    tables.backup(spark, "t1_sessions", str(tmp_path / "copy"))
    tables.append(rows, "t1_sessions")
    assert spark.table("t1_sessions").count() == 4
    tables.restore(spark, str(tmp_path / "copy"), "t1_sessions")
    assert spark.table("t1_sessions").count() == 2
    assert spark.sql("select count(*) as n from t1_sessions where status = 'failed'").first().n == 1
    tables.drop(spark, "t1_")
    assert not any(t.name.startswith("t1_") for t in spark.catalog.listTables())


def test_files_of_models(spark):
    models = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, None)], "id int, model_path string")
    files = spark.createDataFrame([("/a",), ("/a",), ("/c",)], "path string")
    assert {r.id: r.model_file_exists for r in tables.with_file(models, files).collect()} == {1: True, 2: False, 3: False}


def test_progress_is_told_every_ten_files(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("processed" if n % 4 else "failed",) for n in range(8)], "status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    stream = spark.readStream.schema("status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    strokes.run_available(stream, progress.told_once(f"file://{tmp_path}/ledger", lambda done, failed: told.append((done, failed))), str(tmp_path / "c"))
    assert told == [(12, 4), (18, 6)]


def test_open_runs(spark, tmp_path):
    rows = spark.sql("select 'r' || id % 2 as run, timestamp_seconds(id * 60) as ts, if(id = 9, 'completed', 'in_progress') as status, double(id) as progress from range(10)")
    found = {r.run: (r.status, r.progress, r.ended) for r in progress.open_runs(rows).collect()}
    assert found == {"r0": ("in_progress", 8.0, False), "r1": ("completed", 9.0, True)}
