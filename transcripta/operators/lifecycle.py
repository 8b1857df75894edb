"""Tables that change: keyed merges, forgetting, blobs, folders, settings, jobs, export, backups.

Tables are Parquet directories.  A write makes a new version of a table beside the
old one; Spark's own mark of a finished write makes it current, so readers see one
whole version of each table.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exprs import content_hash, fence_of, folder_name
from ..schemas import KEYS, OF_SESSION, TABLES
from .posting_index import Index
from .scratch import settled
from .sequences import latest

#: A file beside a version's data that Spark's readers pass over.
CHECKSUM = "_checksum"
QUARANTINE = "quarantine"
#: Tables that are written or checked side by side.
TOGETHER = 4

T = TypeVar("T")


def replaced_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def upserted(old: DataFrame, new: DataFrame, key: list[str], keep_old: list[str] = ()) -> DataFrame:
    """New rows win; of ``keep_old`` the old value stays where there is one."""
    renamed = old.select(*key, *(F.col(c).alias(f"_old_{c}") for c in keep_old))
    merged = new.join(renamed, key, "left").withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep_old}).drop(*(f"_old_{c}" for c in keep_old))
    return replaced_by_key(old, merged.select(*old.columns), key)


def inserted_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old``, and the rows of ``new`` with other keys, one for each key."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def replaced_of_sessions(old: DataFrame, new: DataFrame, sessions: DataFrame) -> DataFrame:
    """``old`` without all rows of ``sessions`` (session_id), and ``new``."""
    return old.join(sessions.select("session_id").distinct(), "session_id", "left_anti").unionByName(new)


def deduplicated_content(rows: DataFrame, text_col: str, keep: list[str], order: list[str]) -> DataFrame:
    """One row for each content, the first in ``order``, with its address."""
    addressed = rows.withColumn("content_hash", content_hash(F.col(text_col)))
    return latest(addressed.select("content_hash", *keep), ["content_hash"], [F.col(c).asc() for c in order]).withColumn("blob_id", F.concat(F.lit("blob_"), "content_hash"))


def orphans(blobs: DataFrame, references: list[DataFrame], key: str = "id") -> DataFrame:
    """Blobs that none of the one-column tables refers to."""
    every = None
    for table in references:
        column = table.select(F.col(table.columns[0]).alias(key)).where(F.col(key).isNotNull())
        every = column if every is None else every.unionByName(column)
    return blobs.join(every.distinct(), key, "left_anti")


@dataclass(frozen=True)
class Recovery:
    """What recovery found and did: absent, healthy, restored (from ``backup``) or quarantined; ``aside`` holds the damaged archive."""

    outcome: str
    aside: str | None = None
    backup: str | None = None


class Archive:
    """Versioned tables below one path.

    ``versions`` holds one row for each table and version; the highest is current.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self, table: str) -> list[int]:
        """Versions that were written to the end, by the writer's own marker."""
        folder = self._folder(table)
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and self._fs.exists(self._folder(table, n, "_SUCCESS")))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        found = self.versions(table)
        if not found:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}/v{found[-1] if version is None else version}")

    def tables(self) -> dict[str, DataFrame]:
        """One version of every table, for queries that read several."""
        return {name: self.read(name) for name in TABLES}

    def write(self, table: str, rows: DataFrame) -> None:
        version = (self.versions(table) or [0])[-1] + 1
        # a version that a lost writer left unfinished is overwritten
        self._written(rows.select(*(F.col(f.name).cast(f.dataType) for f in TABLES[table])), f"{self.path}/{table}/v{version}")

    def rewrite(self, table: str, rows: DataFrame) -> None:
        """A new version with the rows' own columns, for schema steps."""
        self._written(rows, f"{self.path}/{table}/v{(self.versions(table) or [0])[-1] + 1}")

    def _written(self, rows: DataFrame, path: str) -> None:
        """Writes a table, and beside its files what they hold: rows, and the sum of the rows' hashes."""
        rows.write.mode("overwrite").parquet(path)
        stream = self._fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{CHECKSUM}"), True)
        stream.write(json.dumps(self._sum_of(path, rows.schema)).encode())
        stream.close()

    def _sum_of(self, path: str, schema: StructType) -> dict:
        """The checksum of a table's rows, in whatever order and files they lie."""
        rows = self.spark.read.schema(schema).parquet(path)
        found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hashes")).first()
        return {"rows": found.n, "hashes": found.hashes, "schema": schema.json()}

    def intact(self, path: str) -> bool:
        """Whether a written table can be read and holds what was written."""
        note = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{CHECKSUM}")
        if not self._fs.exists(note) or not self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            return False
        stream = self._fs.open(note)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            wanted = json.loads(text)
            return self._sum_of(path, StructType.fromJson(json.loads(wanted["schema"]))) == wanted
        except (PySparkException, Py4JJavaError, ValueError):
            return False  # files that can't be read are damage, which is what is asked here

    def merge(self, table: str, rows: DataFrame) -> None:
        self.write(table, replaced_by_key(self.read(table), rows.select(*TABLES[table].names), KEYS[table]))

    def together(self, work: list[Callable[[], T]]) -> list[T]:
        """Results of several pieces of work on different tables, as jobs side by side."""
        with ThreadPoolExecutor(TOGETHER) as pool:
            return [f.result() for f in [pool.submit(inheritable_thread_target(w)) for w in work]]

    def replace_sessions(self, tables: dict[str, DataFrame], keep: tuple[str, ...] = ("session_folder",)) -> None:
        """All rows of the sessions in ``tables["agent_session"]`` give way to the new ones; folders stay."""
        sessions = tables["agent_session"].select(F.col("id").alias("session_id"))

        def replace(name: str) -> None:
            new = tables.get(name)
            new = self.spark.createDataFrame([], TABLES[name]) if new is None else self.shaped(name, new)
            self.write(name, replaced_of_sessions(self.read(name), new, sessions))

        self.together([partial(replace, name) for name in OF_SESSION if name not in keep])
        self.merge("agent_session", self.shaped("agent_session", tables["agent_session"]))

    def shaped(self, table: str, rows: DataFrame) -> DataFrame:
        """Columns that a producer never fills are null."""
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[table]))

    def forget(self, session_ids: DataFrame, index: Index | None = None) -> list[str]:
        """The sessions (session_id), all their rows, and blobs that nothing refers to any more.

        ``index`` loses their search documents too.  Returns the paths of their
        sources, which stay where they are and would be ingested again.
        """
        session_ids = settled(session_ids.select("session_id").distinct(), "forgotten")
        sources = self.read("session_source").join(session_ids, "session_id", "left_semi").select(F.col("source_artifact_id").alias("id"))
        paths = [r.path for r in self.read("source_artifact").join(sources, "id", "left_semi").select("path").distinct().orderBy("path").toLocalIterator()]
        if index is not None:
            index.without(self.read("search_document").join(session_ids, "session_id", "left_semi").select("did"))
        self.together([partial(self.write, name, self.read(name).join(session_ids, "session_id", "left_anti")) for name in OF_SESSION])
        self.write("agent_session", self.read("agent_session").join(session_ids.withColumnRenamed("session_id", "id"), "id", "left_anti"))
        blobs = self.read("blob")
        gone = orphans(blobs, [self.read("file_event").select("patch_blob_id"), self.read("message_part").select("blob_id")])
        self.write("blob", blobs.join(gone.select("id"), "id", "left_anti"))
        return paths

    def forget_all(self, reset_manifest: bool = False) -> None:
        """All content; settings and folders stay, jobs too unless the manifest is reset."""
        stay = {"setting", "folder", "job", "ingest_batch"} - ({"job"} if reset_manifest else set())
        self.together([partial(self.write, name, self.spark.createDataFrame([], schema)) for name, schema in TABLES.items() if name not in stay])

    def purge(self, index: Index | None = None) -> list[str]:
        """Drops every copy that forgotten rows could be read from; returns the names of the backups that went.

        Those are older and unfinished versions of all tables, backups, what recovery
        put aside, and the index's dead postings.
        """
        self.prune(1)
        gone = self.backups()
        for folder in ("backups", QUARANTINE):
            self._fs.delete(self._folder(folder), True)
        if index is not None:
            index.compacted()
        return gone

    def forget_everything(self, index: Index | None = None) -> list[str]:
        """All content, and every copy of it; returns the exports, which belong to the user and stay."""
        if index is not None:
            index.without(self.read("search_document").select("did"))
        self.forget_all(reset_manifest=True)
        self.purge(index)
        return self.exports()

    def exports(self) -> list[str]:
        folder = self._folder("exports")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def verify(self, name: str) -> bool:
        """Whether every table of a backup is there and holds what was written."""
        return all(self.together([partial(self.intact, f"{self.path}/backups/{name}/{table}") for table in TABLES]))

    def damaged(self) -> list[str]:
        """Tables whose current version isn't what was written, or which have files but no finished version."""

        def whole(table: str) -> bool:
            found = self.versions(table)
            return self.intact(f"{self.path}/{table}/v{found[-1]}") if found else not self._fs.exists(self._folder(table))

        return [table for table, ok in zip(TABLES, self.together([partial(whole, table) for table in TABLES])) if not ok]

    def recover(self) -> Recovery:
        """Looks first: a healthy archive isn't touched.  A damaged one is put aside whole, then the newest intact backup restored."""
        there = [table for table in TABLES if self._fs.exists(self._folder(table))]
        if not there:
            return Recovery("absent")
        if not self.damaged():
            return Recovery("healthy")
        aside = f"{QUARANTINE}/{uuid.uuid4().hex}"
        self._fs.mkdirs(self._folder(aside))
        for table in there:
            if not self._fs.rename(self._folder(table), self._folder(aside, table)):
                raise OSError(f"can't put aside {self.path}/{table}")
        for name in reversed(self.backups()):
            if self.verify(name):
                self.restore(name)
                return Recovery("restored", f"{self.path}/{aside}", name)
        return Recovery("quarantined", f"{self.path}/{aside}")

    def prune(self, keep: int = 2) -> None:
        """Old versions go, but for the newest ``keep`` of each table, and versions that no writer finished."""
        for table in TABLES:
            kept = {f"v{v}" for v in self.versions(table)[-keep:]}
            if self._fs.exists(self._folder(table)):
                for status in self._fs.listStatus(self._folder(table)):
                    if status.getPath().getName() not in kept:
                        self._fs.delete(status.getPath(), True)

    def due(self, now_ms: int, hours: float) -> bool:
        """Whether the newest backup is older than ``hours``, or there is none."""
        folder = self._folder("backups")
        times = [s.getModificationTime() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return not times or now_ms - max(times) >= hours * 3_600_000

    def backup(self, name: str, keep: int = 10) -> None:
        """A copy of every table's current version; the newest ``keep`` backups stay."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", name):
            raise ValueError("a backup's name is letters, digits, dots, dashes and underscores")
        self.together([partial(self._written, self.read(table), f"{self.path}/backups/{name}/{table}") for table in TABLES])
        for old in self.backups()[: -max(1, min(100, keep))]:
            self._fs.delete(self._folder("backups", old), True)

    def backups(self) -> list[str]:
        folder = self._folder("backups")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def restore(self, name: str) -> None:
        self.together([partial(self.write, table, self.spark.read.schema(schema).parquet(f"{self.path}/backups/{name}/{table}")) for table, schema in TABLES.items()])


# Folders and settings


def next_position(folders: DataFrame) -> DataFrame:
    return folders.agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("position"))


def new_folder(spark: SparkSession, folders: DataFrame, name: str) -> DataFrame:
    """A row for a new folder after the others."""
    now = F.unix_millis(F.current_timestamp())
    row = next_position(folders).select(F.replace(F.uuid(), F.lit("-")).alias("id"), folder_name(F.lit(name)).alias("name"), "position", now.alias("created_at"), now.alias("updated_at"))
    return row


def filed(session_folder: DataFrame, session_id: str, folder_id: str | None) -> DataFrame:
    """A session lies in one folder at most; None takes it out."""
    rest = session_folder.where(F.col("session_id") != session_id)
    if folder_id is None:
        return rest
    now = F.unix_millis(F.current_timestamp())
    row = session_folder.sparkSession.range(1).select(F.lit(session_id).alias("session_id"), F.lit(folder_id).alias("folder_id"), now.alias("created_at"))
    return rest.unionByName(row)


def renamed_folder(folders: DataFrame, folder_id: str, name: str) -> DataFrame:
    own = F.col("id") == folder_id
    return folders.withColumns({"name": F.when(own, folder_name(F.lit(name))).otherwise(F.col("name")), "updated_at": F.when(own, F.unix_millis(F.current_timestamp())).otherwise(F.col("updated_at"))})


def without_folder(folders: DataFrame, session_folder: DataFrame, folder_id: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a folder; its sessions lie in none."""
    return folders.where(F.col("id") != folder_id), session_folder.where(F.col("folder_id") != folder_id)


def with_setting(settings: DataFrame, key: str, value_json: str) -> DataFrame:
    row = settings.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(value_json).alias("value_json"), F.unix_millis(F.current_timestamp()).alias("updated_at"))
    return replaced_by_key(settings, row, ["key"])


def setting(settings: DataFrame, key: str) -> DataFrame:
    """One row: the setting's value, null where it is missing."""
    return settings.agg(F.max(F.when(F.col("key") == key, F.col("value_json"))).alias("value_json"))


def setting_flag(settings: DataFrame, key: str, default: bool) -> DataFrame:
    """One row: the setting as a boolean, the default where it is missing or none."""
    value = F.max(F.when(F.col("key") == key, F.col("value_json").try_cast("boolean")))
    return settings.agg(F.coalesce(value, F.lit(default)).alias("value"))


# Jobs

OUTCOMES = ("enqueued", "coalesced_pending", "marked_redo", "coalesced_done", "coalesced_failed")


def scheduled(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """What becomes of each wanted job (id, priority, payload_json): its outcome and new state."""
    old = jobs.select("id", F.col("state").alias("old_state"), F.col("payload_json").alias("old_payload"), F.col("redo").alias("old_redo"))
    joined = wanted.join(old, "id", "left")
    same = F.col("payload_json").eqNullSafe(F.col("old_payload"))
    outcome = (
        F.when(F.col("old_state") == "pending", "coalesced_pending")
        .when(F.col("old_state") == "running", "marked_redo")
        .when((F.col("old_state") == "done") & same, "coalesced_done")
        .when((F.col("old_state") == "failed") & same, "coalesced_failed")
        .otherwise("enqueued")
    )
    state = F.when(F.col("outcome").isin("enqueued", "coalesced_pending"), "pending").otherwise(F.col("old_state"))
    redo = F.when(F.col("outcome") == "marked_redo", True).when(F.col("outcome") == "enqueued", False).otherwise(F.coalesce("old_redo", F.lit(False)))
    return joined.withColumn("outcome", outcome).withColumn("state", state).withColumn("redo", redo).drop("old_state", "old_payload", "old_redo")


def finished(state: Column, redo: Column) -> Column:
    """A job that was wanted again while it ran is pending again."""
    return F.when((state == "running") & redo, "pending").when(state == "running", "done").otherwise(state)


def recovered(jobs: DataFrame, most_attempts: int = 5) -> DataFrame:
    """Jobs that ran when the process ended wait again, or fail after too many attempts."""
    ran, spent = F.col("state") == "running", F.col("attempts") >= most_attempts
    return jobs.withColumns({"state": F.when(ran & spent, "failed").when(ran, "pending").otherwise(F.col("state")), "error_kind": F.when(ran & spent, "poisoned").otherwise(F.col("error_kind"))})


def queue_depth(jobs: DataFrame, state: str = "state") -> DataFrame:
    return jobs.agg(F.count_if(F.col(state) == "pending").alias("pending"), F.count_if(F.col(state) == "running").alias("running"))


def next_jobs(jobs: DataFrame, count: int = 1) -> DataFrame:
    return jobs.where("state = 'pending'").orderBy(F.desc("priority"), "created_at", "id").limit(count)


# Export


@dataclass(frozen=True)
class Export:
    include_secrets: bool = False


def markdown(tables: dict[str, DataFrame], session_ids: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(session_id, markdown) of each session.

    ``shown`` (source_id, field, text) holds the redacted texts; with it, a field
    that it lacks is left out.  Without it, texts are exported as they are.
    """
    sessions = tables["agent_session"].join(session_ids.withColumnRenamed("session_id", "id"), "id", "left_semi")
    parts = tables["message_part"].join(session_ids, "session_id", "left_semi").select(F.col("id").alias("part_id"), "session_id", "message_id", "seq", "ordinal", "kind", "text", "content_json")
    missing = F.lit("«field unavailable: scan failed»")
    if shown is not None:
        for field in ("text", "content_json"):
            own = shown.where(F.col("field") == field).select(F.col("source_id").alias("part_id"), F.col("text").alias(f"_{field}"))
            parts = parts.join(own, "part_id", "left").withColumn(field, F.when(F.col(field).isNotNull(), F.coalesce(f"_{field}", missing))).drop(f"_{field}")
    body = (
        F.when(F.col("kind") == "opaque", "_[encrypted content omitted]_\n")
        .when((F.col("kind") == "thinking") & F.col("text").isNotNull(), F.concat(F.lit("> _(thinking)_ "), "text", F.lit("\n")))
        .when(F.col("kind") == "thinking", F.lit(None))
        .when(F.col("text").isNotNull(), F.concat("text", F.lit("\n")))
        .when(F.col("content_json").isNotNull(), F.concat(fence_of(F.col("content_json")), F.lit("json\n"), "content_json", F.lit("\n"), fence_of(F.col("content_json")), F.lit("\n")))
    )
    by_message = parts.withColumn("body", body).where("body is not null").groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "body"))).alias("bodies"))
    messages = tables["message"].join(session_ids, "session_id", "left_semi").select("session_id", "seq", "role", F.col("id").alias("message_id")).join(by_message, "message_id", "left")
    block = F.concat_ws("\n", F.concat(F.lit("### "), "role"), F.array_join(F.transform(F.coalesce("bodies", F.array().cast("array<struct<ordinal:bigint,body:string>>")), lambda b: b["body"]), "\n"))
    by_session = messages.withColumn("block", block).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "block"))).alias("blocks"))
    path = F.regexp_replace(F.replace(F.col("path"), F.lit("`"), F.lit("'")), r"[\r\n]", " ")
    files = tables["file_event"].join(session_ids, "session_id", "left_semi").withColumn("line", F.concat(F.lit("- `"), path, F.lit("` ("), "change_kind", F.lit(")"))).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("files"))
    whole = sessions.withColumnRenamed("id", "session_id").join(by_session, "session_id", "left").join(files, "session_id", "left")
    title = F.regexp_replace(F.coalesce("title", F.lit("(untitled session)")), r"[\r\n]", " ")
    warning = "" if shown is not None else " · ⚠ includes flagged secrets"
    head = F.concat(F.lit("# "), title, F.lit("\n\n> "), "agent_id", F.lit(" · "), F.col("message_count").cast("string"), F.lit(" messages · "), F.col("tool_call_count").cast("string"), F.lit(f" tool calls{warning}\n"))
    listed = F.when(F.col("files").isNotNull(), F.concat(F.lit("### Files\n"), F.array_join(F.transform("files", lambda f: f["line"]), "\n")))
    return whole.select("session_id", F.concat_ws("\n", head, F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"), listed).alias("markdown"))
