"""Schema steps: tables of an older version are read as they are and lifted to today's.

A step adds columns, each with SQL for the rows that are there, or makes tables.
The ledger (``schema_migration``) records each
step with a checksum of its SQL; a step that was altered after it had been applied is
refused, and so are steps out of order.  A step's rows are written before its ledger
row, and a column that is there already is only filled where it is null, so a step that
was cut off is applied again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import fnv1a_hex
from ..schemas import TABLES
from .lifecycle import Archive

LEDGER = "schema_migration"
_LEDGER = "version int, name string, checksum string, applied_at bigint"


@dataclass(frozen=True)
class Added:
    """A column that a step adds: ``value`` is SQL over the table, called t, and over what ``joined`` joins to it."""

    table: str
    column: str
    kind: str
    value: str
    joined: str = ""


@dataclass(frozen=True)
class Step:
    """Columns that are added where they are missing or null, and tables that are made empty, as declared today."""

    version: int
    name: str
    added: tuple[Added, ...] = ()
    made: tuple[str, ...] = ()

    def text(self) -> str:
        return "\n".join([*self.made, *(" | ".join((a.table, a.column, a.kind, a.value, a.joined)) for a in self.added)])


_FIRST = ("setting", "job", "agent", "blob", "source_artifact", "source_artifact_path", "ingest_state", "repository", "repository_identity_evidence", "worktree", "agent_session", "session_source", "session_segment", "message", "message_part", "tool_call", "file_event", "git_observation", "secret_finding", "search_document")
_SESSION = "left join agent_session s on s.id = t.session_id"

#: Today's chain.  A step never changes once it is here; what comes later is a step of its own.
STEPS = (
    Step(1, "tables", made=_FIRST),
    Step(2, "job redo", (Added("job", "redo", "boolean", "false"),)),
    Step(3, "job error kind", (Added("job", "error_kind", "string", "null"),)),
    Step(4, "search sort keys", (Added("search_document", "started_at", "bigint", "s.started_at", _SESSION), Added("search_document", "agent_id", "string", "s.agent_id", _SESSION))),
    Step(5, "folders", made=("folder", "session_folder")),
    Step(6, "blob hash algorithm", (Added("blob", "hash_algo", "string", "'sha256'"),)),
    Step(7, "observation metadata", (Added("git_observation", "metadata_json", "string", "null"),)),
    Step(8, "ingest ledger", made=("ingest_batch",)),
)


class MigrationError(Exception):
    """A chain that can't be applied: out of order, altered, or from a later version."""


def _checksum(archive: Archive, step: Step) -> str:
    return archive.spark.range(1).select(fnv1a_hex(F.lit(step.text())).alias("x")).first().x


def _stored(archive: Archive, table: str) -> DataFrame | None:
    """A table with the columns that it was written with; None where it isn't there."""
    found = archive.versions(table)
    return archive.spark.read.parquet(f"{archive.path}/{table}/v{found[-1]}") if found else None


def ledger(archive: Archive) -> DataFrame:
    """(version, name, checksum, applied_at) of the applied steps."""
    path = archive.path + f"/{LEDGER}"
    jvm = archive.spark._jvm.org.apache.hadoop.fs
    there = jvm.Path(path).getFileSystem(archive.spark._jsc.hadoopConfiguration()).exists(jvm.Path(path))
    rows = archive.spark.read.schema(_LEDGER).parquet(path) if there else archive.spark.createDataFrame([], _LEDGER)
    return rows.groupBy("version").agg(F.max_by("name", "applied_at").alias("name"), F.max_by("checksum", "applied_at").alias("checksum"), F.max("applied_at").alias("applied_at"))


def _lifted(archive: Archive, rows: DataFrame, step: Added) -> DataFrame:
    if step.column not in rows.columns:
        rows = rows.withColumn(step.column, F.lit(None).cast(step.kind))
    sessions = _stored(archive, "agent_session")
    views = {"t": rows, "agent_session": archive.read("agent_session") if sessions is None else sessions}
    kept = ", ".join(f"t.{c}" for c in rows.columns if c != step.column)
    return archive.spark.sql(f"select {kept}, coalesce(t.{step.column}, cast({step.value} as {step.kind})) as {step.column} from {{t}} t {step.joined.replace('agent_session', '{agent_session}')}", **views)


def pending(archive: Archive, steps: tuple[Step, ...] = STEPS) -> list[Step]:
    """The steps that aren't applied yet; raises for a chain that drifted."""
    versions = [s.version for s in steps]
    if versions != sorted(set(versions)):
        raise MigrationError("steps are out of order")
    applied = {r.version: r for r in ledger(archive).collect()}  # a row for each step
    unknown = sorted(set(applied) - set(versions))
    if unknown:
        raise MigrationError(f"the archive is of a later version: step {unknown[-1]} isn't known here")
    for step in steps:
        if step.version in applied and applied[step.version].checksum != _checksum(archive, step):
            raise MigrationError(f"step {step.version} was altered after it had been applied")
    return [s for s in steps if s.version not in applied]


def migrate(archive: Archive, steps: tuple[Step, ...] = STEPS, now_ms: int = 0) -> list[int]:
    """Applies what is pending, in order; returns the versions applied."""
    done = []
    for step in pending(archive, steps):
        for table in dict.fromkeys(a.table for a in step.added):
            rows = _stored(archive, table)
            if rows is not None:
                for added in (a for a in step.added if a.table == table):
                    rows = _lifted(archive, rows, added)
                archive.rewrite(table, rows)
        for table in step.made:
            if not archive.versions(table):
                archive.rewrite(table, archive.spark.createDataFrame([], TABLES[table]))
        row = archive.spark.createDataFrame([(step.version, step.name, _checksum(archive, step), now_ms)], _LEDGER)
        row.write.mode("append").parquet(f"{archive.path}/{LEDGER}")
        done.append(step.version)
    return done
