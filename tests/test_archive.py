"""The archive end to end: ingest, the drain stream, enrichment, recovery, forgetting, migrations, files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from transcripta.operators import enrichment, files, ingest, lifecycle, migrations
from transcripta.operators.posting_index import Index
from transcripta.schemas import TABLES
from transcripta.sources.transcripts import discovered
from transcripta.streaming import drain

SECRET = "gh" + "p_" + "a1B2" * 9


def record(session, uuid, text, role="user", cwd="/w"):
    return json.dumps({"type": role, "uuid": uuid, "sessionId": session, "timestamp": "2026-02-03T10:00:00Z", "cwd": cwd, "message": {"role": role, "content": text}})


def write(folder, name, *records):
    (folder / name).write_text("\n".join(records) + "\n")


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    for name in ("a", "archive", "state", "checkpoint"):
        (root / name).mkdir()
    write(root / "a", "one.jsonl", record("s1", "u1", f"use {SECRET} now"), record("s1", "u2", "done", "assistant"))
    write(root / "a", "two.jsonl", record("s2", "u3", "first half"))
    write(root / "a", "bad.jsonl", record("s3", "same", "x"), record("s3", "same", "y"))
    return root


@pytest.fixture(scope="module")
def archive(spark, root):
    return lifecycle.Archive(spark, f"file://{root}/archive")


def content(archive, but=()):
    """All rows of all tables, without times of writing."""
    out = {}
    for name, rows in archive.tables().items():
        if name not in but:
            kept = [c for c in rows.columns if not c.endswith("_at") or c == "started_at"]
            out[name] = sorted(map(str, rows.select(*kept).collect()))
    return out


def facts_of(spark, taken=50):
    def facts(folders):
        return folders.where("cwd = '/w'").select("cwd", F.lit("/w/.git").alias("common_dir"), F.lit("/w").alias("workdir"), F.lit("main").alias("branch"), F.lit("c1").alias("head"), F.lit(False).alias("detached"), F.lit(True).alias("dirty"), F.array(F.lit("https://git.example.com/team/tool.git")).alias("remotes"), F.array(F.lit("r1")).alias("roots"), F.lit(False).alias("truncated"), F.lit(taken).cast("long").alias("taken_at"))

    return facts


def run(archive, root, **options):
    query = drain.drained(archive, {"claude-code": [f"file://{root}/a"]}, f"file://{root}/state", f"file://{root}/checkpoint", **options)
    query.awaitTermination()


def test_the_stream_ingests_enriches_and_survives_a_killed_batch(spark, archive, root, tmp_path, monkeypatch):
    told = []
    listener = drain.Progress(told.append)
    spark.streams.addListener(listener)
    merge = lifecycle.Archive.merge

    def dying(self, table, rows):
        if table == "agent_session":
            raise RuntimeError("killed")
        merge(self, table, rows)

    monkeypatch.setattr(lifecycle.Archive, "merge", dying)
    with pytest.raises(Exception, match="killed"):
        run(archive, root, facts=facts_of(spark))
    monkeypatch.undo()
    assert archive.read("message").count() and archive.read("ingest_batch").isEmpty()
    run(archive, root, facts=facts_of(spark))
    # the same files into an archive that nothing happened to
    calm = lifecycle.Archive(spark, f"file://{tmp_path}/calm")
    for name in ("state", "checkpoint"):
        (tmp_path / name).mkdir()
    drain.drained(calm, {"claude-code": [f"file://{root}/a"]}, f"file://{tmp_path}/state", f"file://{tmp_path}/checkpoint", facts=facts_of(spark)).awaitTermination()
    assert content(archive, {"ingest_batch"}) == content(calm, {"ingest_batch"})
    batch = archive.read("ingest_batch").first()
    assert (batch.changed, batch.ingested, batch.skipped, batch.failed, batch.deleted, batch.linked) == (3, 2, 0, 1, 0, 2)
    # a batch of the ledger isn't written again
    before = archive.versions("message")
    drain.batch_into(archive, f"file://{root}/checkpoint")(spark.createDataFrame([("claude-code", "x", 1, 1, None, "new")], "agent_id string, path string, size bigint, mtime_ms bigint, old_size bigint, kind string"), batch.batch)
    assert archive.versions("message") == before
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    for _ in range(100):
        if any(e["event"] == "batch" and e["changed"] == 3 for e in told):
            break
        __import__("time").sleep(0.1)
    spark.streams.removeListener(listener)
    seen = [e for e in told if e["event"] == "batch" and e["changed"] == 3]
    assert seen and seen[0]["new"] == 3 and seen[0]["bytes"] > 0


def test_a_grown_file_replaces_its_session_and_others_are_skipped(spark, archive, root):
    with (root / "a" / "two.jsonl").open("a") as f:
        f.write(record("s2", "u4", "second half") + "\n")
    (root / "a" / "bad.jsonl").unlink()
    run(archive, root)
    assert {r.title: r.message_count for r in archive.read("agent_session").collect()}["first half"] == 2
    last = archive.read("ingest_batch").orderBy(F.desc("batch")).first()
    assert (last.changed, last.ingested, last.deleted) == (2, 1, 1)
    # nothing to parse: nothing of a session is written
    before = archive.versions("message")
    report = ingest.ingest(archive, discovered(spark, "claude-code", [f"file://{root}/a"]))
    assert report == {"skipped": 2, "failed": 0, "ingested": 0} and archive.versions("message") == before


def test_secrets_never_reach_search_documents(archive):
    texts = [r.text for r in archive.read("search_document").collect()]
    assert texts and not any(SECRET in t for t in texts)
    findings = ingest.session_findings(archive.read("secret_finding"), archive.read("agent_session").select(F.col("id").alias("session_id"))).collect()
    assert [f.field for f in findings] == ["text"]


def test_enrichment_is_incremental(spark, archive):
    facts = facts_of(spark)(spark.createDataFrame([("/w",)], "cwd string"))
    repository = archive.read("repository").first()
    assert repository.display_name == "tool" and repository.primary_path == "/w"
    assert {r.resolution_confidence for r in archive.read("session_segment").collect()} == {"high", "unresolved"}
    report = enrichment.enrich(archive, facts, F.lit(9))
    assert report["linked"] == 1 and enrichment.enrich(archive, facts, F.lit(10)) == {"waiting": 0, "linked": 0}
    assert archive.read("repository_identity_evidence").count() == 3 and archive.read("worktree").count() == 1
    # a recorded commit is checked once for each time that facts are taken
    segment = archive.read("session_segment").first()
    recorded = spark.createDataFrame([("g_1", segment.session_id, segment.id, "agent_recorded", "near_event", "main", "c1")], "id string, session_id string, segment_id string, source string, temporal_confidence string, branch string, commit_sha string")
    archive.merge("git_observation", archive.shaped("git_observation", recorded))
    commits = spark.createDataFrame([(segment.repository_id, "c1")], "repository_id string, commit_sha string")
    refs = spark.createDataFrame([(segment.repository_id, "main", "c2")], "repository_id string, branch string, commit_sha string")
    none = spark.createDataFrame([], "path string, reason string, taken_at bigint")
    assert enrichment.reverify(archive, facts, commits, refs, none) == 1 and enrichment.reverify(archive, facts, commits, refs, none) == 0
    found = archive.read("git_observation").where("source = 'reverified'").first()
    assert found.commit_exists and json.loads(found.metadata_json) == {"commit_exists": True, "branch_exists": True, "branch_at_recorded_commit": False}
    gone = spark.createDataFrame([("/w", "path_missing", 60)], "path string, reason string, taken_at bigint")
    assert enrichment.reverify(archive, facts, commits, refs, gone) == 1
    assert archive.read("worktree").first().is_missing and archive.read("git_observation").where("source = 'reverified'").first().commit_exists is None
    assert archive.read("git_observation").where("source = 'agent_recorded'").count() == 1


def test_recovery_looks_before_it_restores(spark, archive, root, tmp_path):
    assert lifecycle.Archive(spark, f"file://{tmp_path}/none").recover().outcome == "absent"
    before = content(archive)
    assert archive.recover().outcome == "healthy" and archive.due(0, 1)
    archive.backup("first")
    assert archive.verify("first") and not archive.due(0, 1)
    archive.backup("second")
    # the newest backup is damaged, and so is a table
    for place in ("backups/second/message", f"message/v{archive.versions('message')[-1]}"):
        part = next(p for p in (root / "archive" / place).iterdir() if p.name.startswith("part-") and p.stat().st_size)
        part.write_bytes(part.read_bytes()[:-9])
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert archive.damaged() == ["message"]
    found = archive.recover()
    assert (found.outcome, found.backup) == ("restored", "first") and content(archive) == before
    assert (root / "archive" / "quarantine").exists() and archive.damaged() == []


def test_a_table_that_lost_a_file_is_damaged(spark, tmp_path):
    archive = lifecycle.Archive(spark, f"file://{tmp_path}/x")
    archive.write("folder", spark.createDataFrame([(str(k), "n", k, 1, 1) for k in range(10)], TABLES["folder"]).repartition(5))
    part = next(p for p in (tmp_path / "x/folder/v1").iterdir() if p.name.startswith("part-") and p.stat().st_size)
    part.unlink()
    assert archive.damaged() == ["folder"]
    assert archive.recover().outcome == "quarantined" and archive.versions("folder") == []


def test_forgetting_and_purging_leave_no_copy(spark, archive, root, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index").build(archive.read("search_document").select("did", "text"))
    session = archive.read("agent_session").where("title like 'use%' or title like '%now%'").first()
    assert session is not None
    paths = archive.forget(spark.createDataFrame([(session.id,)], "session_id string"), index)
    assert [os.path.basename(p) for p in paths] == ["one.jsonl"]
    assert archive.read("message").where(F.col("session_id") == session.id).isEmpty() and index.ranked(["done"]).count() == 0
    # a version that no writer finished
    (root / "archive/message/v99").mkdir()
    (root / "archive/message/v99/part-0").write_bytes(b"done")
    assert archive.purge(index) == ["first", "second"]
    left = [p for p in (root / "archive").rglob("*") if p.is_file()] + list((tmp_path / "index").rglob("*.parquet"))
    assert not [p for p in left if "/backups/" in str(p) or "/quarantine/" in str(p) or "/v99/" in str(p)]
    found = spark.read.option("recursiveFileLookup", "true").schema(TABLES["message"]).parquet(f"{archive.path}/message")
    assert found.where(F.col("session_id") == session.id).isEmpty() and len(archive.versions("message")) == 1
    assert archive.forget_everything(index) == [] and archive.read("agent_session").isEmpty() and index.totals()[0] == 0


def test_older_archives_are_lifted(spark, tmp_path):
    archive = lifecycle.Archive(spark, f"file://{tmp_path}/old")
    sessions = spark.createDataFrame([("s", "codex", 7)], "id string, agent_id string, started_at bigint")
    archive.write("agent_session", archive.shaped("agent_session", sessions))
    archive.rewrite("search_document", spark.createDataFrame([(1, "s", "session", "s", "title", 0, "t"), (2, "lost", "session", "x", "title", 0, "t")], "did bigint, session_id string, source_kind string, source_id string, field string, ordinal int, text string"))
    archive.rewrite("job", spark.createDataFrame([("j", "done")], "id string, state string"))
    assert [s.version for s in migrations.pending(archive)] == list(range(1, 9))
    assert migrations.migrate(archive) == list(range(1, 9)) and migrations.migrate(archive) == []
    assert {(r.did, r.started_at, r.agent_id) for r in archive.read("search_document").collect()} == {(1, 7, "codex"), (2, None, None)}
    assert archive.read("job").first().redo is False and archive.versions("folder") and archive.damaged() == []
    altered = (*migrations.STEPS[:-1], migrations.Step(8, "ingest ledger", made=("ingest_batch", "folder")))
    with pytest.raises(migrations.MigrationError, match="altered"):
        migrations.pending(archive, altered)
    with pytest.raises(migrations.MigrationError, match="later version"):
        migrations.pending(archive, migrations.STEPS[:3])
    with pytest.raises(migrations.MigrationError, match="order"):
        migrations.pending(archive, migrations.STEPS[::-1])
    later = (*migrations.STEPS, migrations.Step(9, "pinned", (migrations.Added("folder", "pinned", "boolean", "false"),)))
    assert migrations.migrate(archive, later) == [9]


@pytest.mark.parametrize("name", ["", "/etc/x", "../x", "a/../../x", "~/x", "a/..", ".", "a\\b", "c:x", "a\nb"])
def test_names_that_could_lead_out_are_refused(spark, tmp_path, name):
    with pytest.raises(ValueError):
        files.safe_relpath(name)
    row = files.saved(spark.createDataFrame([(name, b"x")], "name string, content binary"), f"file://{tmp_path}").first()
    assert row.error and row["size"] is None and not list(tmp_path.iterdir())


def test_files_are_written_read_and_removed(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a//b/./c.md", b"text"), ("d.bin", None)], "name string, content binary")
    assert {(r.name, r["size"], r.error) for r in files.saved(rows, root).collect()} == {("a/b/c.md", 4, None), ("d.bin", 0, None)}
    assert [r.error is None for r in files.saved(rows.limit(1), root, replace=False).collect()] == [False]
    names = spark.createDataFrame([("a/b/c.md",), ("none",), ("../x",)], "name string")
    assert {r.name: (bytes(r.content) if r.content is not None else None, r.error is None) for r in files.loaded(names, root).collect()} == {"a/b/c.md": (b"text", True), "none": (None, False), "../x": (None, False)}
    (tmp_path / "secret").write_text("x")
    (tmp_path / "out" / "link").symlink_to(tmp_path / "secret")
    (tmp_path / "out" / "dir").symlink_to(tmp_path)
    led = spark.createDataFrame([("link",), ("dir/secret",)], "name string")
    assert all(r.error for r in files.loaded(led, root).collect()) and all(r.error for r in files.removed(led, root).collect())
    assert (tmp_path / "secret").exists()
    assert {r.name: r.error for r in files.removed(names.limit(2), root).collect()} == {"a/b/c.md": None, "none": "not there"}
    assert not (tmp_path / "out/a/b/c.md").exists() and not [p for p in (tmp_path / "out").rglob(".*")]
    shown = spark.createDataFrame([("s:1", "# T")], "session_id string, markdown string")
    saved = files.saved_exports(shown, spark.createDataFrame([("s:1", "../My title: ✓")], "id string, title string"), root).first()
    assert saved.name == "My-title-s_1.md" and (tmp_path / "out" / saved.name).read_text() == "# T"
