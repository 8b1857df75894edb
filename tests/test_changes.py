import json

from pyspark.sql import functions as F

from transcripta.operators import lifecycle
from transcripta.streaming import changes


def _files(spark, folder):
    return spark.read.format("binaryFile").load(str(folder)).select("path", "modificationTime", "length", "content")


def test_change_classes_of_real_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in {"same": "a\nb\n", "grown": "a\n", "cut": "abcdef\n", "other": "xyz\n"}.items():
        (folder / name).write_text(text)
    old = spark.createDataFrame(changes.fingerprints(_files(spark, folder)).withColumn("generation", F.lit(0)).toPandas())
    assert {r.path.rsplit("/", 1)[-1]: (r.last_complete_offset, r.last_complete_line) for r in old.collect()}["same"] == (4, 2)
    for name, text in {"grown": "a\nmore", "cut": "abc", "other": "XYZ\n+", "fresh": "1"}.items():
        (folder / name).write_text(text)
    new = changes.fingerprints(_files(spark, folder), old)
    got = {r.path.rsplit("/", 1)[-1]: (r.change, r.generation) for r in changes.classified(new, old).collect()}
    assert got == {"same": ("unchanged", 0), "grown": ("appended", 0), "cut": ("truncated", 1), "other": ("rewritten", 1), "fresh": ("new", 0)}
    assert changes.to_parse(changes.classified(new, old)).count() == 4


def test_a_followed_manifest_replaces_rows(spark, tmp_path):
    announced, data, table = tmp_path / "manifest", tmp_path / "data", f"file://{tmp_path}/table"
    announced.mkdir(), data.mkdir()
    lines = spark.createDataFrame([], "path string, text string")
    lines.write.parquet(table + "/0")
    state = {"version": 0}

    def ingest(rows):
        merged = lifecycle.replaced_by_key(spark.read.parquet(f"{table}/{state['version']}"), rows, ["path"])
        state["version"] += 1
        merged.write.parquet(f"{table}/{state['version']}")

    def read(paths):
        return spark.read.format("binaryFile").load(paths).select("path", F.col("content").cast("string").alias("text"))

    def run(name, *files):
        (announced / name).write_text("".join(json.dumps({"path": str(data / f), "mtime_ms": k, "size": 1}) + "\n" for k, f in enumerate(files)))
        stream = spark.readStream.schema("path string, mtime_ms long, size long").json(str(announced))
        changes.follow(stream, read, ingest, f"{tmp_path}/checkpoint").awaitTermination()

    (data / "a").write_text("1")
    run("one.json", "a", "a", "a")
    (data / "a").write_text("1 and 2")
    (data / "b").write_text("x")
    run("two.json", "a", "b")
    rows = {r.path.rsplit("/", 1)[-1]: r.text for r in spark.read.parquet(f"{table}/{state['version']}").collect()}
    assert rows == {"a": "1 and 2", "b": "x"} and state["version"] == 2


def test_jobs_and_folders(spark):
    jobs = spark.createDataFrame([("a", "pending", "p", False), ("b", "running", "p", False), ("c", "done", "p", False), ("d", "failed", "p", False)], "id string, state string, payload_json string, redo boolean")
    wanted = spark.createDataFrame([(k, p) for k, p in zip("abcde", "xxpqx")], "id string, payload_json string")
    got = {r.id: (r.outcome, r.state, r.redo) for r in lifecycle.scheduled(jobs, wanted).collect()}
    assert got == {"a": ("coalesced_pending", "pending", False), "b": ("marked_redo", "running", True), "c": ("coalesced_done", "done", False), "d": ("enqueued", "pending", False), "e": ("enqueued", "pending", False)}
    held = spark.createDataFrame([("s", "f1", 1)], "session_id string, folder_id string, created_at long")
    assert [r.folder_id for r in lifecycle.filed(held, "s", "f2").collect()] == ["f2"]
    assert lifecycle.filed(held, "s", None).count() == 0
    settings = spark.createDataFrame([("on", "true"), ("odd", '"x"')], "key string, value_json string")
    assert [lifecycle.setting_flag(settings, k, False).first()[0] for k in ("on", "odd", "none")] == [True, False, False]
