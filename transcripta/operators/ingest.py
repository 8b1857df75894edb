"""Composed ingest: transcript files to every table of the archive, and a row for each file that fails.

A batch of files is one job.  Files are told from their last ingestion by path, or
by their native id and content where they were moved; unchanged ones are skipped,
others are parsed whole and replace their session by key, so a batch that runs
again changes nothing.  A file that can't be read, is too large or breaks a key
fails alone.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.exprs import content_hash, det_id
from ..schemas import KEYS
from ..sources.transcripts import MOST_BYTES, lines, oversized
from ..streaming.changes import classified, fingerprints
from .git_facts import recorded
from .lifecycle import Archive, deduplicated_content, replaced_by_key
from .scratch import settled
from .secrets import patch_state, scanned, searchable
from .sequences import latest
from .transcripts import search_documents, search_fields, vendor_a, vendor_b

PARSER_VERSION = "1"


@dataclass(frozen=True)
class Adapter:
    """A vendor's format: what it is called, what it records, and how its lines become tables."""

    id: str
    display_name: str
    parse: Callable[[DataFrame], dict[str, DataFrame]]
    capabilities: dict[str, bool] = field(default_factory=dict)


_RECORDS = {"threaded_messages": True, "sidechains": True, "token_counts": True, "file_patches": False, "git_commits": False}


class Registry:
    """Adapters by agent id; an id is registered once."""

    def __init__(self, *adapters: Adapter):
        self.adapters: dict[str, Adapter] = {}
        for adapter in adapters:
            self.add(adapter)

    def add(self, adapter: Adapter) -> None:
        if adapter.id in self.adapters:
            raise ValueError(f"an adapter is registered already: {adapter.id}")
        self.adapters[adapter.id] = adapter

    def agents(self, files: DataFrame) -> DataFrame:
        """Rows of the table "agent"."""
        rows = [(a.id, a.display_name, None, json.dumps(a.capabilities, sort_keys=True)) for _, a in sorted(self.adapters.items())]
        return files.sparkSession.createDataFrame(rows, "id string, display_name string, version string, capabilities_json string")


def both_vendors() -> Registry:
    return Registry(
        Adapter("claude-code", "Claude Code", vendor_a, _RECORDS),
        Adapter("codex", "Codex", vendor_b, {**_RECORDS, "threaded_messages": False, "sidechains": False, "file_patches": True, "git_commits": True}),
    )


def found_sources(manifest: DataFrame, artifacts: DataFrame, states: DataFrame) -> DataFrame:
    """Manifest rows (agent_id, path, native_file_id, full_hash, ...) with the artifact that each is, if known.

    The path decides; else a file of the same native id and content that was seen
    last (it was moved).
    """
    old = artifacts.join(states.select(F.col("source_artifact_id").alias("id"), "parser_version", "status"), "id", "left")
    facts = F.struct("id", "size", "prefix_hash", "full_hash", "generation", "parser_version", "status")
    by_path = old.select("agent_id", "path", facts.alias("_here"))
    moved = latest(old.where("native_file_id is not null"), ["agent_id", "native_file_id", "full_hash"], [F.col("last_seen_at").desc_nulls_last(), F.col("id")])
    moved = moved.select("agent_id", "native_file_id", "full_hash", facts.alias("_moved"))
    joined = manifest.join(by_path, ["agent_id", "path"], "left").join(moved, ["agent_id", "native_file_id", "full_hash"], "left")
    # an artifact that is still at its path hasn't moved, and one that has is one file: the first by path
    here = joined.where("_here is not null").select(F.col("_here.id").alias("_id")).distinct().withColumn("_stays", F.lit(True))
    asked = joined.withColumn("_id", F.when(F.col("_here").isNull(), F.col("_moved.id"))).join(here, "_id", "left")
    claimed = asked.where("_id is not null and _stays is null").groupBy("_id").agg(F.min("path").alias("_path"))
    told = asked.join(claimed, "_id", "left").withColumn("known", F.coalesce("_here", F.when(F.col("path") == F.col("_path"), F.col("_moved"))))
    return told.drop("_here", "_moved", "_id", "_stays", "_path")


def detached(old_links: DataFrame, new_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links that stay, sessions without a source) when sources now belong to the sessions of ``new_links``."""
    now = new_links.select("source_artifact_id", F.col("session_id").alias("_now")).distinct()
    judged = old_links.join(now, "source_artifact_id", "left").withColumn("_stays", F.col("_now").isNull() | (F.col("_now") == F.col("session_id")))
    stays = judged.where("_stays").select(*old_links.columns)
    supported = stays.select("session_id").unionByName(new_links.select("session_id")).distinct()
    gone = judged.where("not _stays").select("session_id").distinct().join(supported, "session_id", "left_anti")
    return stays, gone


def _manifest(files: DataFrame, artifacts: DataFrame, states: DataFrame) -> DataFrame:
    """Fingerprints of the files, the artifacts they are, their change class and generation."""
    sizes = artifacts.select("path", "size")
    rows = fingerprints(files.where(F.col("length") <= MOST_BYTES), sizes)
    native = files.select("agent_id", "path", F.col("native_file_id") if "native_file_id" in files.columns else F.lit(None).cast("string").alias("native_file_id"))
    rows = found_sources(rows.join(native, "path"), artifacts, states)
    before = rows.where("known is not null").select("path", "known.size", "known.full_hash", "known.prefix_hash", "known.generation")
    rows = classified(rows, before)
    fresh = det_id("sa", F.col("agent_id"), F.coalesce("native_file_id", "path"), F.col("path"))
    skipped = (F.col("change") == "unchanged") & (F.col("known.parser_version") == PARSER_VERSION) & (F.col("known.status") == "ok")
    return rows.withColumns({"artifact_id": F.coalesce("known.id", fresh), "skipped": F.coalesce(skipped, F.lit(False))})


def ingested(files: DataFrame, artifacts: DataFrame, states: DataFrame, now: Column, registry: Registry | None = None, seen: Observation | None = None) -> dict[str, DataFrame]:
    """Rows that a batch of files (agent_id, path, modificationTime, length, content) brings, by table.

    Besides: "skipped" (path) and "failures" (agent_id, path, kind, reason).  A vendor
    without a file to parse isn't planned; where none has one, the tables of a session
    are missing.  ``seen`` observes how many files there are and are skipped.
    """
    registry = registry or both_vendors()
    routed = F.coalesce(F.col("agent_id").isin(*registry.adapters), F.lit(False))
    manifest = _manifest(files.where(routed), artifacts, states)
    if seen is not None:
        manifest = manifest.observe(seen, F.count("*").alias("files"), F.count_if("skipped").alias("skipped"))
    manifest = settled(manifest, "ingest-manifest")
    unrouted = files.where(~routed).select("agent_id", "path", F.lit("adapter_not_registered").alias("kind"), F.lit("no adapter has this agent id").alias("reason"))
    skipped = manifest.where("skipped").select("path")
    agents = registry.agents(files)
    asked = {r.agent_id for r in manifest.where("not skipped").select("agent_id").distinct().collect()}  # a row for each adapter at most
    if not asked:
        return {"agent": agents, "skipped": skipped, "failures": unrouted} | _source_tables(manifest, now)
    parse = files.where(routed).join(manifest.where("not skipped").select("path"), "path", "left_semi").select("agent_id", "path", "length", "content")
    every = lines(parse)
    out: dict[str, DataFrame] = {}
    for name in sorted(asked):
        for table, rows in registry.adapters[name].parse(every.where(F.col("agent_id") == name)).items():
            out[table] = out[table].unionByName(rows) if table in out else rows
    out["agent_session"] = out["agent_session"].unionByName(oversized(parse), allowMissingColumns=True)
    # read by several tables, and parsed once
    shared = ("agent_session", "message_part", "file_event", "session_segment")
    with ThreadPoolExecutor(len(shared)) as pool:
        out |= dict(zip(shared, pool.map(inheritable_thread_target(lambda table: settled(out[table], "ingest-parsed")), shared)))

    found, shown = searchable(search_fields(out))
    keys = ("session_id", "source_kind", "source_id", "field")
    found = found.select(det_id("sf", *(F.col(k) for k in keys), F.col("ordinal")).alias("id"), *keys, "rule", "span_start", "span_end", "severity", "value_fingerprint", "disposition", now.alias("created_at"))
    patches = out["file_event"].where("patch_text is not null").withColumn("content_hash", content_hash(F.col("patch_text")))
    texts = deduplicated_content(patches, "patch_text", ["patch_text", "id"], ["id"])
    status = patch_state(scanned(F.col("patch_text"))["status"])
    blobs = texts.select(F.col("blob_id").alias("id"), "content_hash", F.lit("sha256").alias("hash_algo"), F.octet_length("patch_text").cast("long").alias("byte_size"), F.lit("text/x-diff").alias("media_type"), F.lit("none").alias("compression"), status.alias("scan_state"), F.encode("patch_text", "UTF-8").alias("content"))

    links = out["session_source"].join(manifest.select("agent_id", "path", F.col("artifact_id").alias("source_artifact_id")), ["agent_id", "path"])
    broken = out["failures"].select("agent_id", "path", F.lit("source_failed").alias("kind"), "reason")
    return {
        **{k: v for k, v in out.items() if k not in ("failures", "notes", "session_source", "native_ids")},
        "file_event": out["file_event"].withColumn("patch_blob_id", F.when(F.col("patch_text").isNotNull(), F.concat(F.lit("blob_"), content_hash(F.col("patch_text"))))),
        "agent": agents,
        "blob": blobs,
        "secret_finding": found,
        "search_document": search_documents(shown, out["agent_session"]),
        "git_observation": recorded(out["session_segment"]).withColumn("observed_at", now),
        "session_source": links.select("session_id", "source_artifact_id", "first_seq", "last_seq"),
        "skipped": skipped,
        "failures": broken.unionByName(unrouted),
        "notes": out["notes"],
    } | _source_tables(manifest.join(broken.select("path"), "path", "left_anti"), now)


def _source_tables(seen: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What the archive knows of the files of a manifest."""
    return {
        "source_artifact": seen.select(F.col("artifact_id").alias("id"), "agent_id", "path", "native_file_id", "size", "mtime_ms", "prefix_hash", "full_hash", "generation", F.lit("active").alias("state"), now.alias("last_seen_at")),
        "source_artifact_path": seen.select(F.col("artifact_id").alias("source_artifact_id"), "path", now.alias("first_seen_at"), now.alias("last_seen_at")),
        "ingest_state": seen.select(F.col("artifact_id").alias("source_artifact_id"), F.lit(PARSER_VERSION).alias("parser_version"), "last_complete_offset", "last_complete_line", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), now.alias("updated_at")),
    }


def ingest(archive: Archive, files: DataFrame, registry: Registry | None = None, now: Column | None = None) -> dict[str, int]:
    """Ingests a batch into the archive: how many files came in, were skipped, and failed.

    Rows of sessions go in before the sessions, and what is known of the files after
    both: a batch that dies is parsed again by the next, and replaces its own rows.
    The counts are observed while tables are written that are needed anyway.
    """
    now = F.lit(int(time.time() * 1000)).cast("long") if now is None else now
    seen, failed = (Observation(f"{kind}-{uuid.uuid4().hex}") for kind in ("files", "failures"))
    rows = ingested(files, archive.read("source_artifact"), archive.read("ingest_state"), now, registry, seen)
    settled(rows["failures"].observe(failed, F.count("*").alias("failed"), F.count_if(F.col("kind") == "source_failed").alias("broken")), "ingest-failures")
    report = {"skipped": seen.get["skipped"], "failed": failed.get["failed"], "ingested": seen.get["files"] - seen.get["skipped"] - failed.get["broken"]}
    old_paths = archive.read("source_artifact_path").select("source_artifact_id", "path", F.col("first_seen_at").alias("_first"))
    paths = rows["source_artifact_path"].join(old_paths, ["source_artifact_id", "path"], "left")
    merged = {**rows, "source_artifact_path": paths.withColumn("first_seen_at", F.coalesce("_first", "first_seen_at")).drop("_first")}
    gone = None
    if "agent_session" in rows:
        links, gone = detached(archive.read("session_source"), rows["session_source"])
        gone = settled(gone, "ingest-gone")
        links = replaced_by_key(links, archive.shaped("session_source", rows["session_source"]), KEYS["session_source"])
        archive.together([partial(archive.merge, table, archive.shaped(table, merged[table])) for table in ("agent", "blob")])
        archive.write("session_source", links)
        archive.replace_sessions(rows, keep=("session_folder", "session_source"))
        if not gone.isEmpty():
            archive.forget(gone)
    archive.together([partial(archive.merge, table, archive.shaped(table, merged[table])) for table in ("source_artifact_path", "ingest_state", "source_artifact")])
    return report


def session_findings(findings: DataFrame, session_ids: DataFrame) -> DataFrame:
    """The findings of sessions (session_id), the gravest first."""
    order = F.element_at(F.create_map(*(F.lit(x) for k, s in enumerate(("critical", "high", "medium", "low")) for x in (s, k))), F.col("severity"))
    return findings.join(session_ids, "session_id", "left_semi").orderBy("session_id", order, "source_id", "field", "span_start")
