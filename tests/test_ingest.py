import json

import pytest
from pyspark.sql import functions as F

from transcripta.operators import ingest, lifecycle
from transcripta.schemas import TABLES
from transcripta.sources.transcripts import discovered, discovery, installations, lines, with_root, without_root

SECRET = "gh" + "p_" + "a1B2" * 9


def _record(session, uuid, text, role="user"):
    return json.dumps({"type": role, "uuid": uuid, "sessionId": session, "timestamp": "2026-02-03T10:00:00Z", "cwd": "/w", "message": {"role": role, "content": text}})


def _write(folder, name, *records):
    (folder / name).write_text("\n".join(records) + "\n")


@pytest.fixture
def folders(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    _write(a, "one.jsonl", _record("s1", "u1", f"use {SECRET} now"), _record("s1", "u2", "done", "assistant"))
    _write(a, "part-1.jsonl", _record("s2", "u3", "first half"))
    _write(a, "part-2.jsonl", _record("s2", "u3", "first half"), _record("s2", "u4", "second half"))
    _write(a, "bad.jsonl", _record("s3", "same", "x"), _record("s3", "same", "y"))
    _write(b, "rollout-1.jsonl", json.dumps({"type": "session_meta", "payload": {"id": "native-b", "cwd": "/p"}}))
    return a, b


def test_moved_files_are_found_by_native_id_and_content(spark):
    artifacts = spark.createDataFrame([("sa_1", "codex", "/old", "f1", 10, 0, "p", "h", 2, "active", 5), ("sa_2", "codex", "/there", None, 10, 0, "p", "h2", 0, "active", 5)], TABLES["source_artifact"])
    states = spark.createDataFrame([("sa_1", "1", 0, 0, "ok", None, 0)], TABLES["ingest_state"])
    manifest = spark.createDataFrame([("codex", "/new", "f1", "h"), ("codex", "/new2", "f1", "other"), ("codex", "/there", "f1", "h")], "agent_id string, path string, native_file_id string, full_hash string")
    got = {r.path: r.known.id if r.known else None for r in ingest.found_sources(manifest, artifacts, states).collect()}
    assert got == {"/new": "sa_1", "/new2": None, "/there": "sa_2"}


def test_an_agent_is_registered_once(spark):
    registry = ingest.both_vendors()
    with pytest.raises(ValueError):
        registry.add(registry.adapters["codex"])
    agents = registry.agents(spark.range(1)).collect()
    assert [r.id for r in agents] == ["claude-code", "codex"] and json.loads(agents[1].capabilities_json)["file_patches"]


def test_roots(spark, folders):
    roots = with_root([str(folders[0])], "/nowhere/at/all")
    assert without_root(roots, "/nowhere/at/all/") == [str(folders[0])]
    found = discovery(spark, {"claude-code": roots, "codex": [str(folders[1])]})
    own = [r.path for r in found.collect() if str(folders[0].parent) in r.path]
    assert len(own) == 5
    assert not [r for r in discovery(spark, {"codex": [str(folders[1])]}, disabled=("codex",)).collect() if str(folders[1]) in r.path]


def test_installations(spark, folders, tmp_path):
    (tmp_path / "empty").mkdir()
    got = installations(spark, {"claude-code": [str(folders[0]), "/not/there"], "codex": [f"{tmp_path}/empty/"]}).collect()
    assert {(r.agent_id, r.root, r.there, r.files, r.newest is not None) for r in got} == {("claude-code", str(folders[0]), True, 4, True), ("claude-code", "/not/there", False, 0, False), ("codex", f"{tmp_path}/empty", True, 0, False)}


def test_two_files_of_one_content_are_two_artifacts(spark):
    artifacts = spark.createDataFrame([("sa_1", "codex", "/old", "f1", 10, 0, "p", "h", 2, "active", 5)], TABLES["source_artifact"])
    states = spark.createDataFrame([("sa_1", "1", 0, 0, "ok", None, 0)], TABLES["ingest_state"])
    manifest = "agent_id string, path string, native_file_id string, full_hash string"
    both = spark.createDataFrame([("codex", "/b", "f1", "h"), ("codex", "/a", "f1", "h")], manifest)
    assert {r.path: r.known.id if r.known else None for r in ingest.found_sources(both, artifacts, states).collect()} == {"/a": "sa_1", "/b": None}
    # a file that is still at its place hasn't moved
    copied = both.unionByName(spark.createDataFrame([("codex", "/old", "f1", "h")], manifest))
    assert {r.path: r.known.id if r.known else None for r in ingest.found_sources(copied, artifacts, states).collect()} == {"/a": None, "/b": None, "/old": "sa_1"}


def test_many_lines_of_one_file(spark):
    content = b"\n".join(b"line %d" % k for k in range(60_000))
    files = spark.createDataFrame([("codex", "p", len(content), content)], "agent_id string, path string, length bigint, content binary")
    got = lines(files).agg(F.count("*").alias("n"), F.max("byte_offset").alias("last")).first()
    assert (got.n, got.last) == (60_000, len(content) - len(b"line 59999"))


def test_folders_and_settings(spark):
    folders = spark.createDataFrame([("f1", "One", 0, 1, 1), ("f2", "Two", 1, 1, 1)], TABLES["folder"])
    filed = spark.createDataFrame([("s", "f1", 1), ("t", "f2", 1)], TABLES["session_folder"])
    assert {r.name for r in lifecycle.renamed_folder(folders, "f2", "  New ​ name ").collect()} == {"One", "New name"}
    left, links = lifecycle.without_folder(folders, filed, "f1")
    assert [r.id for r in left.collect()] == ["f2"] and [r.session_id for r in links.collect()] == ["t"]
    settings = lifecycle.with_setting(lifecycle.with_setting(spark.createDataFrame([], TABLES["setting"]), "k", "true"), "k", "false")
    assert settings.count() == 1 and lifecycle.setting(settings, "k").first()[0] == "false" and lifecycle.setting_flag(settings, "k", True).first()[0] is False
    assert lifecycle.setting(settings, "other").first()[0] is None
