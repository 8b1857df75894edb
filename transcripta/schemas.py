"""Schemas of the archive's tables, and their keys."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

_TYPES = {"string": StringType(), "bigint": LongType(), "int": IntegerType(), "boolean": BooleanType(), "double": DoubleType(), "binary": BinaryType()}


def _schema(text: str) -> StructType:
    """Columns as "name type, ..."; needs no session, unlike DDL."""
    out = StructType()
    for column in text.split(", "):
        name, kind = column.split(" ")
        out = out.add(name, _TYPES[kind])
    return out


TABLES: dict[str, StructType] = {
    "setting": _schema("key string, value_json string, updated_at bigint"),
    "job": _schema("id string, kind string, state string, priority bigint, payload_json string, attempts int, redo boolean, error string, error_kind string, created_at bigint, updated_at bigint"),
    "agent": _schema("id string, display_name string, version string, capabilities_json string"),
    "blob": _schema("id string, content_hash string, hash_algo string, byte_size bigint, media_type string, compression string, scan_state string, content binary"),
    "source_artifact": _schema("id string, agent_id string, path string, native_file_id string, size bigint, mtime_ms bigint, prefix_hash string, full_hash string, generation int, state string, last_seen_at bigint"),
    "source_artifact_path": _schema("source_artifact_id string, path string, first_seen_at bigint, last_seen_at bigint"),
    "ingest_state": _schema("source_artifact_id string, parser_version string, last_complete_offset bigint, last_complete_line bigint, status string, error string, updated_at bigint"),
    "repository": _schema("id string, identity_key string, display_name string, primary_path string, identity_confidence string, is_missing boolean, created_at bigint, updated_at bigint"),
    "repository_identity_evidence": _schema("id string, repository_id string, kind string, value_hash string, confidence string"),
    "worktree": _schema("id string, repository_id string, path string, is_main boolean, is_missing boolean"),
    "agent_session": _schema("id string, agent_id string, native_session_id string, dedupe_key string, title string, title_is_synthetic boolean, started_at bigint, ended_at bigint, message_count bigint, tool_call_count bigint, input_tokens bigint, output_tokens bigint, cache_tokens bigint, est_cost_usd double, primary_model string, agent_version string, parse_status string, parse_note string, metadata_json string"),
    "session_source": _schema("session_id string, source_artifact_id string, first_seq bigint, last_seq bigint"),
    "session_segment": _schema("id string, session_id string, segment_ix bigint, seq_start bigint, seq_end bigint, cwd string, model string, provider string, repository_id string, worktree_id string, context_source string, resolution_confidence string, git_branch string, git_commit_sha string, git_remote_url string"),
    "message": _schema("id string, session_id string, seq bigint, segment_id string, native_uuid string, parent_id string, role string, event_kind string, is_sidechain boolean, ts bigint, model string, input_tokens bigint, output_tokens bigint, cache_tokens bigint, stop_reason string, source_offset bigint, metadata_json string"),
    "message_part": _schema("id string, message_id string, session_id string, seq bigint, ordinal bigint, kind string, text string, content_json string, searchable boolean, blob_id string, metadata_json string"),
    "tool_call": _schema("id string, session_id string, call_part_id string, result_part_id string, native_call_id string, name string, input_json string, output_text string, is_error boolean, duration_ms bigint"),
    "file_event": _schema("id string, session_id string, segment_id string, tool_call_id string, path string, change_kind string, old_path string, lines_added bigint, lines_removed bigint, patch_text string, patch_blob_id string, source string, event_ts bigint, observed_at bigint"),
    "git_observation": _schema("id string, session_id string, segment_id string, source string, temporal_confidence string, branch string, commit_sha string, is_detached boolean, is_dirty boolean, remote_url_norm string, observed_at bigint, event_ts bigint, commit_exists boolean, metadata_json string"),
    "secret_finding": _schema("id string, session_id string, source_kind string, source_id string, field string, rule string, span_start bigint, span_end bigint, severity string, value_fingerprint string, disposition string, created_at bigint"),
    "search_document": _schema("did bigint, session_id string, source_kind string, source_id string, field string, ordinal int, text string, started_at bigint, agent_id string"),
    "folder": _schema("id string, name string, position int, created_at bigint, updated_at bigint"),
    "session_folder": _schema("session_id string, folder_id string, created_at bigint"),
    "ingest_batch": _schema("stream string, batch bigint, changed bigint, ingested bigint, skipped bigint, failed bigint, deleted bigint, linked bigint, finished_at bigint"),
}

#: The columns that identify a row of each table.
KEYS: dict[str, list[str]] = {
    "setting": ["key"],
    "job": ["id"],
    "agent": ["id"],
    "blob": ["id"],
    "source_artifact": ["id"],
    "source_artifact_path": ["source_artifact_id", "path"],
    "ingest_state": ["source_artifact_id"],
    "repository": ["id"],
    "repository_identity_evidence": ["id"],
    "worktree": ["id"],
    "agent_session": ["id"],
    "session_source": ["session_id", "source_artifact_id"],
    "session_segment": ["id"],
    "message": ["id"],
    "message_part": ["id"],
    "tool_call": ["id"],
    "file_event": ["id"],
    "git_observation": ["id"],
    "secret_finding": ["id"],
    "search_document": ["did"],
    "folder": ["id"],
    "session_folder": ["session_id"],
    "ingest_batch": ["stream", "batch"],
}

#: Tables whose rows go with their session.
OF_SESSION = ("session_source", "session_segment", "message", "message_part", "tool_call", "file_event", "git_observation", "secret_finding", "search_document", "session_folder")
