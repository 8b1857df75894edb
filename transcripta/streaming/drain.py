"""A stream that keeps an archive up to date with watched folders: ingest, then enrichment, batch by batch.

The archive's ledger (``ingest_batch``) says which batches of which stream are in it.  A
batch's row is written after all its other rows, so a batch that was cut off runs again
whole and replaces by key what it had written; one that is in the ledger is passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.enrichment import enrich
from ..operators.ingest import Registry, ingest
from ..operators.lifecycle import Archive
from ..operators.scratch import settled
from ..sources.watched import watched

COUNTS = "watched"


def _plain(path: str):
    """A file's URI with one slash after its scheme where it has no host, as some readers write it."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_files(spark: SparkSession, changes: DataFrame) -> DataFrame:
    """(agent_id, path, modificationTime, length, content) of the changed files that are there."""
    # a batch's paths: the source's option "most" bounds them
    paths = [r.path for r in changes.where("kind <> 'deleted'").select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "agent_id string, path string, modificationTime timestamp, length bigint, content binary")
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths)
    return files.join(changes.select(_plain("path").alias("_path"), "agent_id"), _plain("path") == F.col("_path")).select("agent_id", "path", "modificationTime", "length", "content")


def vanished(artifacts: DataFrame, deleted: DataFrame) -> DataFrame:
    """Artifacts whose file is gone: their sessions stay, their state says so."""
    gone = deleted.select(_plain("path").alias("_path")).distinct().withColumn("_gone", F.lit(True))
    joined = artifacts.join(gone, _plain("path") == F.col("_path"), "left")
    return joined.where("_gone").withColumn("state", F.lit("missing")).select(*artifacts.columns)


def batch_into(archive: Archive, stream: str, registry: Registry | None = None, facts: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """The work of one batch; ``facts`` gives the Git facts of the folders (cwd) that it is asked for."""
    spark = archive.spark

    def batch(rows: DataFrame, number: int) -> None:
        done = archive.read("ingest_batch").where((F.col("stream") == stream) & (F.col("batch") == number))
        if not done.isEmpty():
            return
        changes = settled(rows, "drain-changes")
        counts = changes.agg(F.count("*").alias("changed"), F.count_if(F.col("kind") == "deleted").alias("deleted"), F.max("mtime_ms").alias("at")).first()
        if not counts.changed:
            return
        # the batch's own time, so that a repetition writes the same rows
        now = F.lit(counts.at).cast("long")
        report = ingest(archive, read_files(spark, changes), registry, now)
        if counts.deleted:
            archive.merge("source_artifact", vanished(archive.read("source_artifact"), changes.where("kind = 'deleted'")))
        linked = 0
        if facts is not None:
            folders = archive.read("session_segment").where("cwd is not null and repository_id is null").select("cwd").distinct()
            linked = enrich(archive, facts(folders), now)["linked"]
        row = spark.range(1).select(F.lit(stream).alias("stream"), F.lit(number).alias("batch"), *(F.lit(v).alias(k) for k, v in {"changed": counts.changed, "deleted": counts.deleted, "linked": linked, **report}.items()), now.alias("finished_at"))
        archive.merge("ingest_batch", archive.shaped("ingest_batch", row))

    return batch


def drained(archive: Archive, roots: dict[str, list[str]], state: str, checkpoint: str, registry: Registry | None = None, facts: Callable[[DataFrame], DataFrame] | None = None, once: bool = True, every: str = "2 seconds", **options) -> StreamingQuery:
    """Starts the stream of ``roots`` into the archive: all that is there once, or for as long as it runs."""
    changes = watched(archive.spark, roots, state, **options)
    counts = [F.count("*").alias("changed"), F.sum("size").alias("bytes"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("new", "grown", "shrunk", "touched", "deleted"))]
    writer = changes.observe(COUNTS, *counts).writeStream.foreachBatch(batch_into(archive, checkpoint, registry, facts)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


class Progress(StreamingQueryListener):
    """Tells ``told`` what each batch brought: its number, how long it took, and the observed counts."""

    def __init__(self, told: Callable[[dict], None]):
        self.told = told

    def onQueryStarted(self, event) -> None:
        self.told({"event": "started", "query": str(event.id)})

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(COUNTS)
        if seen is not None:
            self.told({"event": "batch", "query": str(event.progress.id), "batch": event.progress.batchId, "ms": event.progress.batchDuration, **seen.asDict()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.told({"event": "failed" if event.exception else "ended", "query": str(event.id)})
