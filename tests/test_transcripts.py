import json

import pytest

from transcripta.functions.exprs import det_id
from transcripta.operators import git_facts, lifecycle, search, secrets
from transcripta.operators import transcripts as t
from transcripta.functions.cursors import Query
from transcripta.sources.transcripts import discovered, lines, oversized, synthetic

SECRET = "gh" + "p_" + "a1B2" * 9


def _write(folder, name, records):
    path = folder / name
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))
    return path


def _a(kind, uuid, content=None, parent=None, cwd="/work", branch="main", time="10:00:00", **message):
    record = {"type": kind, "uuid": uuid, "parentUuid": parent, "sessionId": "native-a", "timestamp": f"2026-02-03T{time}.250Z", "cwd": cwd, "gitBranch": branch, "version": "2.0"}
    if content is not None:
        record["message"] = {"role": kind, "content": content, **message}
    return record


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    a, b = tmp_path_factory.mktemp("a"), tmp_path_factory.mktemp("b")
    _write(
        a,
        "one.jsonl",
        [
            _a("user", "u2", "# Fix the   login\nplease", parent="u1"),
            _a("assistant", "u1", [{"type": "thinking", "thinking": "hm", "signature": "s"}, {"type": "text", "text": f"key {SECRET} né"}, {"type": "tool_use", "id": "c1", "name": "Edit", "input": {"file_path": "/work/../src/./app.ts"}}], time="10:00:05", model="m-1", usage={"input_tokens": 100, "output_tokens": 7, "cache_read_input_tokens": 3}),
            _a("user", "u3", [{"type": "tool_result", "tool_use_id": "c1", "is_error": True, "content": [{"type": "text", "text": "no"}, "such"]}, {"type": "tool_result", "tool_use_id": "zz", "content": "x"}], cwd="/other"),
            "{broken",
            {"type": "surprise"},
            "",
            _a("assistant", "u4", [{"type": "hologram", "x": 1}, {"type": "tool_use", "id": "c2", "name": "Write", "input": {"file_path": 5, "path": "p"}}], cwd="/other", usage={"input_tokens": 20}),
        ],
    )
    twice = [_a("user", "same", "one"), _a("user", "same", "two")]
    _write(a, "bad.jsonl", [{**r, "sessionId": "native-bad"} for r in twice])
    _write(
        b,
        "rollout-1.jsonl",
        [
            {"type": "session_meta", "timestamp": "2026-02-03T09:00:00Z", "payload": {"id": "native-b", "cwd": "/p", "cli_version": "0.1", "model_provider": "prov", "git": {"branch": "main", "commit_hash": "abc", "repository_url": "https://me:pw@Host.example:443/o/r.git"}}},
            {"type": "turn_context", "timestamp": "2026-02-03T09:00:01Z", "payload": {"model": "g"}},
            {"type": "response_item", "timestamp": "2026-02-03T09:00:02Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "run it"}, {"image": 1}, "now"]}},
            {"type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": "s"}], "content": "c", "encrypted_content": "zzz"}},
            {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "{}", "call_id": "k"}},
            {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "k", "output": {"code": 1}, "status": "failed"}},
            {"type": "event_msg", "timestamp": "2026-02-03T09:00:09Z", "payload": {"type": "patch_apply_end", "call_id": "k", "changes": {"b.ts": {"type": "update", "unified_diff": "--- a\n+++ b\n-x\n+y\n+z\n"}, "a.ts": {"type": "add", "content": "new"}, "old.ts": {"type": "update", "move_path": "moved.ts"}}}},
            {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 120, "output_tokens": 30, "cached_input_tokens": 40, "cache_write_input_tokens": 5}}}},
            {"type": "event_msg", "payload": {"type": "context_compacted"}},
            {"type": "compacted", "payload": {"message": "in short"}},
        ],
    )
    files = discovered(spark, "claude-code", [str(a)]).unionByName(discovered(spark, "codex", [str(b)]))
    return {name: df.cache() for name, df in t.of_both(lines(files)).items()}


def test_sessions(tables):
    rows = {r.native_session_id: r for r in tables["agent_session"].collect()}
    a, b = rows["native-a"], rows["native-b"]
    assert (a.title, a.title_is_synthetic, a.message_count, a.tool_call_count) == ("Fix the login", True, 4, 2)
    assert (a.input_tokens, a.output_tokens, a.cache_tokens, a.primary_model, a.agent_version) == (120, 7, 3, "m-1", "2.0")
    assert a.parse_status == "partial" and a.parse_note.startswith("4 parser note(s); first: ")
    assert a.ended_at - a.started_at == 5000 and a.started_at % 1000 == 250
    assert (b.title, b.message_count, b.tool_call_count, b.parse_status) == ("run it", 6, 1, "ok")
    assert (b.input_tokens, b.output_tokens, b.cache_tokens, b.primary_model) == (120, 30, 45, None)
    assert "native-bad" not in rows
    assert [r.reason for r in tables["failures"].collect()] == ["a native id occurs twice"]


def test_messages_and_parts(tables):
    rows = {r.native_uuid: r for r in tables["message"].where("native_uuid is not null").collect()}
    assert rows["u2"].parent_id == rows["u1"].id and rows["u1"].seq == 1
    parts = tables["message_part"].collect()
    assert len({p.id for p in parts}) == len(parts)
    own = sorted((p for p in parts if p.message_id == rows["u1"].id), key=lambda p: p.ordinal)
    assert [(p.kind, p.searchable) for p in own] == [("thinking", False), ("text", True), ("tool_use", False)]
    assert [p.text for p in parts if p.kind == "tool_result" and p.content_json == '"x"'] == ["x"]
    thoughts = sorted((p for p in parts if p.kind in ("thinking", "opaque") and p.message_id != rows["u1"].id), key=lambda p: p.ordinal)
    assert [(p.kind, p.text) for p in thoughts] == [("thinking", "s"), ("thinking", "c"), ("opaque", None)]
    texts = sorted((p.ordinal, p.text) for p in parts if p.text in ("run it", "now"))
    assert texts == [(0, "run it"), (1, "now")]
    seqs = [r.seq for r in tables["message"].where("native_uuid is null").orderBy("seq").collect()]
    assert seqs == [0, 1, 2, 3, 4, 5]


def test_tools_and_files(tables):
    calls = {r.native_call_id: r for r in tables["tool_call"].collect()}
    assert (calls["c1"].is_error, calls["c1"].output_text, calls["c1"].name) == (True, "no\nsuch", "Edit")
    assert calls["c2"].result_part_id is None and calls["c2"].is_error is None
    assert (calls["k"].is_error, calls["k"].output_text) == (True, '{"code":1}')
    files = {r.path: r for r in tables["file_event"].collect()}
    assert set(files) == {"src/app.ts", "a.ts", "b.ts", "moved.ts"}
    assert (files["b.ts"].lines_added, files["b.ts"].lines_removed, files["b.ts"].change_kind) == (2, 1, "edit")
    assert (files["moved.ts"].old_path, files["moved.ts"].change_kind) == ("old.ts", "move")
    assert files["a.ts"].tool_call_id == calls["k"].id and files["src/app.ts"].tool_call_id == calls["c1"].id


def test_segments_and_git(tables):
    rows = sorted(tables["session_segment"].collect(), key=lambda r: (r.session_id, r.segment_ix))
    spans = sorted((r.cwd, r.seq_start, r.seq_end, r.model) for r in rows)
    assert spans == [("/other", 2, 3, None), ("/p", 0, 5, "g"), ("/work", 0, 1, None)]
    seen = {r.branch: r for r in git_facts.recorded(tables["session_segment"]).collect() if r.commit_sha}
    assert seen["main"].remote_url_norm == "host.example/o/r"
    segment_ids = {r.id for r in rows}
    assert {r.segment_id for r in tables["message"].collect()} <= segment_ids


def test_no_secret_is_searchable(spark, tables):
    found, shown = secrets.searchable(t.search_fields(tables))
    assert [(r.rule, r.field, r.severity) for r in found.where("field = 'text'").collect()] == [("github-token", "text", "critical")]
    documents = t.search_documents(shown, tables["agent_session"])
    assert not any(SECRET in r.text for r in documents.collect())
    page = search.search(documents, tables["agent_session"], Query(terms=["login"]))
    assert len(page.hits) == 1 and page.hits[0].title == "Fix the login" and page.next_cursor is None
    filtered = search.search(documents, tables["agent_session"], Query(terms=["run"], tool="shell", has_error=True), tool_calls=tables["tool_call"])
    assert len(filtered.hits) == 1
    assert not search.search(documents, tables["agent_session"], Query(terms=["run"], tool="Edit"), tool_calls=tables["tool_call"]).hits


def test_archive_replaces_forgets_and_restores(spark, tables, tmp_path):
    archive = lifecycle.Archive(spark, f"file://{tmp_path}")
    rows = {k: v for k, v in tables.items() if k not in ("failures", "notes")}
    archive.replace_sessions(rows)
    archive.replace_sessions(rows)
    assert archive.read("message").count() == tables["message"].count()
    archive.backup("one")
    ids = archive.read("agent_session").where("agent_id = 'codex'").selectExpr("id session_id")
    archive.forget(ids)
    assert archive.read("agent_session").count() == 1
    assert archive.read("message_part").join(archive.read("message").selectExpr("id message_id"), "message_id", "left_anti").count() == 0
    archive.restore("one")
    assert archive.read("agent_session").count() == 2 and archive.backups() == ["one"]
    archive.prune(1)
    assert len(archive.versions("message")) == 1
    text = lifecycle.markdown(rows, rows["agent_session"].selectExpr("id session_id")).where("markdown like '%shell%'").first().markdown
    assert "_[encrypted content omitted]_" in text and "### Files\n- `" in text


def test_lines_have_byte_offsets(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes('é\r\n\n  \nlast'.encode())
    rows = lines(discovered(spark, "claude-code", [str(tmp_path)])).orderBy("line_no").collect()
    assert [(r.byte_offset, r.raw) for r in rows] == [(0, "é"), (8, "last")]
    assert oversized(discovered(spark, "claude-code", [str(tmp_path)])).count() == 0


def test_synthetic_sessions_keep_their_invariants(spark):
    rows = synthetic(spark, 6, 5).selectExpr("agent_id", "path", "line_no", "line_no * 100 byte_offset", "raw")
    made = t.of_both(rows)
    assert made["agent_session"].count() == 6 and made["message"].count() == 30
    orphans = made["message"].join(made["session_segment"].selectExpr("id segment_id"), "segment_id", "left_anti")
    assert orphans.count() == 0
    assert made["session_segment"].where("seq_start > seq_end").count() == 0


def test_ids_are_fnv1a(spark):
    from pyspark.sql import functions as F

    def plain(prefix, *parts):
        h = 0xCBF29CE484222325
        for byte in "\x1f".join(parts).encode():
            h = (h ^ byte) * 0x100000001B3 % (1 << 64)
        return f"{prefix}_{h:016x}"

    got = spark.range(1).select(det_id("m", F.lit("s-é"), F.lit(0))).first()[0]
    assert got == plain("m", "s-é", "0")


def test_lines_are_made_once(spark):
    from pyspark.sql import functions as F

    from transcripta.operators.transcripts import vendor_b

    seen = spark.sparkContext.accumulator(0)

    def raw(x):
        seen.add(1)
        return x

    rows = [("codex", "f.jsonl", k, k, '{"type":"response_item","payload":{"type":"message","role":"user","content":"hi"}}') for k in range(3)]
    made = spark.createDataFrame(rows, "agent_id string, path string, line_no long, byte_offset long, raw string")
    tables = vendor_b(made.withColumn("raw", F.udf(raw, "string")("raw")))
    assert tables["message"].count() == 3 and seen.value == 3


@pytest.mark.parametrize("agent", ["claude-code", "codex"])
def test_only_lines_sessions_and_their_keys_are_settled(spark, agent):
    from transcripta.operators import scratch
    from transcripta.plans import transcripts as plans

    made_lines, vendor = (plans._lines_a, t.vendor_a) if agent == "claude-code" else (plans._lines_b, t.vendor_b)
    with scratch.noted() as made:
        tables = vendor(made_lines(spark, "/root/testdata/sf0.001"))
    assert len(made) == 3
    # raw lines aren't kept beside what was parsed of them, and the notes of all kinds read them a few times only
    assert "raw" not in spark.read.parquet(made[0]).columns
    assert tables["notes"]._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 5


def test_sessions_are_named_without_their_counts(spark):
    from transcripta.operators.transcripts import vendor_b

    raw = ['{"type":"session_meta","payload":{"id":"n-1"}}', '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"one"}]}}']
    rows = [("codex", path, k, k, line) for path in ("rollout-1.jsonl", "rollout-2.jsonl") for k, line in enumerate(raw)] + [("codex", "rollout-3.jsonl", 0, 0, raw[1])]
    tables = vendor_b(spark.createDataFrame(rows, "agent_id string, path string, line_no long, byte_offset long, raw string"))
    named = tables["native_ids"]
    assert sorted(map(str, named.collect())) == sorted(str(r) for r in tables["agent_session"].selectExpr("id session_id", "native_session_id").collect())
    # no aggregate of messages, calls or titles stands behind a name
    assert "Join" not in named._jdf.queryExecution().optimizedPlan().toString()


def test_sessions_are_not_broadcast_to_their_parts(spark):
    from transcripta.plans import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for name in ("rollout_parts", "parsed_parts"):
            rows = catalog.queries()[name](spark, "/root/testdata/sf0.001")
            assert rows.count() and "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
