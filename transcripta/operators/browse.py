"""Browsing: keyset pages of sessions and messages, details, repositories, folders, counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cursors import clamp, read_message_cursor, read_session_cursor, session_cursor
from ..functions.exprs import after_newest

MOST_PAGE = 10_000
MOST_MESSAGES = 1_000
OPENED_MESSAGES = 200
SUMMARY = ("id", "agent_id", "title", "started_at", "ended_at", "message_count", "tool_call_count", "primary_model", "parse_status")


@dataclass
class SessionPage:
    sessions: list
    next_cursor: str | None


def newest(rows: DataFrame, time: str, key: str, limit: int, after: tuple[int | None, object] | None = None) -> DataFrame:
    """The ``limit`` rows after a cursor, newest first, rows without a time last."""
    if after is not None:
        rows = rows.where(after_newest(F.col(time), F.col(key), *after))
    return rows.orderBy(F.col(time).desc_nulls_last(), F.col(key).desc()).limit(limit)


def with_any(rows: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """The rows that have a partner, each once."""
    return rows.join(other.select(on), on, "left_semi")


def summaries(sessions: DataFrame) -> DataFrame:
    return sessions.select(*SUMMARY)


def session_page(sessions: DataFrame, limit: int, cursor: str | None = None) -> SessionPage:
    """One row more than asked tells whether there is a next page."""
    limit = clamp(limit, 1, MOST_PAGE)
    rows = newest(summaries(sessions), "started_at", "id", limit + 1, read_session_cursor(cursor)).collect()
    more, rows = len(rows) > limit, rows[:limit]
    return SessionPage(rows, session_cursor(rows[-1].started_at, rows[-1].id) if more else None)


def of_repository(sessions: DataFrame, segments: DataFrame, repository_id: str) -> DataFrame:
    touched = segments.where(F.col("repository_id") == repository_id).select(F.col("session_id").alias("id"))
    return with_any(sessions, touched, "id")


def of_folder(sessions: DataFrame, session_folder: DataFrame, folder_id: str) -> DataFrame:
    held = session_folder.where(F.col("folder_id") == folder_id).select(F.col("session_id").alias("id"))
    return sessions.join(held, "id")


def masked_part(kind: Column, value: Column) -> Column:
    """Opaque parts show no content."""
    return F.when(kind == "opaque", F.lit(None)).otherwise(value)


def with_parts(messages: DataFrame, parts: DataFrame, key: str = "id", part_key: str = "message_id") -> DataFrame:
    """Messages with their parts as one array, in order of ordinals."""
    shown = parts.select(F.col(part_key).alias(key), F.struct("ordinal", "kind", masked_part(F.col("kind"), F.col("text")).alias("text"), masked_part(F.col("kind"), F.col("content_json")).alias("content_json"), "searchable").alias("part"))
    grouped = shown.groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return messages.join(grouped, key, "left")


def message_page(messages: DataFrame, parts: DataFrame, session_id: str, limit: int, cursor: str | None = None) -> tuple[list, str | None]:
    """Messages after a sequence number, with parts, and the next cursor."""
    limit = clamp(limit, 1, MOST_MESSAGES)
    own = messages.where(F.col("session_id") == session_id)
    if (after := read_message_cursor(cursor)) is not None:
        own = own.where(F.col("seq") > after)
    shown = own.orderBy("seq").limit(limit + 1)
    # the parts of a page lie in one session: filtered by it before the join
    rows = with_parts(shown, parts.where(F.col("session_id") == session_id)).orderBy("seq").collect()
    more, rows = len(rows) > limit, rows[:limit]
    return rows, str(rows[-1].seq) if more else None


def opened(tables: dict[str, DataFrame], session_id: str) -> dict[str, object] | None:
    """A session with segments, its first messages with parts, file events and Git facts."""
    head = summaries(tables["agent_session"]).where(F.col("id") == session_id).collect()
    if not head:
        return None
    mine = F.col("session_id") == session_id
    messages, cursor = message_page(tables["message"], tables["message_part"], session_id, OPENED_MESSAGES)
    return {
        "summary": head[0],
        "segments": tables["session_segment"].where(mine).orderBy("seq_start").collect(),
        "messages": messages,
        "next_cursor": cursor,
        "file_events": tables["file_event"].where(mine).withColumn("has_patch", F.col("patch_blob_id").isNotNull()).orderBy("id").collect(),
        "git": tables["git_observation"].where(mine).orderBy("observed_at", "source", "id").collect(),
    }


def counts_by(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name))


def repository_summary(repositories: DataFrame, segments: DataFrame, worktrees: DataFrame) -> DataFrame:
    """Each repository with its distinct sessions and its worktrees; zero where it has none."""
    sessions = segments.where("repository_id is not null").groupBy("repository_id").agg(F.countDistinct("session_id").alias("session_count"))
    trees = counts_by(worktrees, "repository_id", "worktree_count")
    joined = repositories.join(sessions, repositories["id"] == sessions["repository_id"], "left").drop("repository_id").join(trees, repositories["id"] == trees["repository_id"], "left").drop("repository_id")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("session_count", "worktree_count")}).orderBy("display_name", "id")


def folder_list(folders: DataFrame, session_folder: DataFrame) -> DataFrame:
    held = counts_by(session_folder, "folder_id", "thread_count").withColumnRenamed("folder_id", "id")
    return folders.join(held, "id", "left").withColumn("thread_count", F.coalesce("thread_count", F.lit(0))).orderBy("position", "name", "id")


def shown_patch(state: Column, content: Column) -> Column:
    """A patch's text; null while it is quarantined or not UTF-8."""
    return F.when(state == "failed_quarantined", F.lit(None)).otherwise(F.try_validate_utf8(content.cast("string")))


def patches(file_events: DataFrame, blobs: DataFrame) -> DataFrame:
    """File events that have a patch, with its blob's state and content."""
    held = blobs.select(F.col("id").alias("patch_blob_id"), "scan_state", "content")
    return file_events.select("id", "session_id", "patch_blob_id").join(held, "patch_blob_id")
