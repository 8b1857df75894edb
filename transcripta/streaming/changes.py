"""Incremental ingestion: manifests, change classes, and a stream of changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import replaced_by_key

#: Bytes at a file's start whose hash tells an append from a rewrite.
PREFIX = 4096
MANIFEST = "path string, size bigint, mtime_ms bigint, prefix_hash string, full_hash string, last_complete_offset bigint, last_complete_line bigint"


def fingerprints(files: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """A manifest row for each binary file (path, modificationTime, length, content).

    With a previous manifest, ``head_hash`` is the hash of as many bytes as the old
    prefix had, to tell an append.
    """
    # one character for each byte, so that places are byte places
    text = F.expr("decode(content, 'ISO-8859-1')")
    complete = F.length(text) - F.length(F.substring_index(text, "\n", -1))
    rows = files.select(
        F.col("path"),
        F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
        F.sha2(F.expr(f"substring(content, 1, {PREFIX})"), 256).alias("prefix_hash"),
        F.sha2("content", 256).alias("full_hash"),
        complete.cast("long").alias("last_complete_offset"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n")))).cast("long").alias("last_complete_line"),
        F.col("content"),
    )
    if previous is not None:
        old = previous.select("path", F.col("size").alias("old_size"))
        rows = rows.join(old, "path", "left").withColumn("head_hash", F.sha2(F.expr(f"substring(content, 1, least({PREFIX}, coalesce(old_size, 0)))"), 256)).drop("old_size")
    return rows.drop("content")


def classified(new: DataFrame, old: DataFrame) -> DataFrame:
    """Each new manifest row with its change class and generation.

    ``head_hash`` is the new file's hash over the bytes of the old prefix.
    """
    before = old.select("path", F.col("size").alias("old_size"), F.col("full_hash").alias("old_full"), F.col("prefix_hash").alias("old_prefix"), F.col("generation").alias("old_generation"))
    joined = new.join(before, "path", "left")
    change = (
        F.when(F.col("old_full").isNull(), "new")
        .when(F.col("full_hash") == F.col("old_full"), "unchanged")
        .when((F.col("size") > F.col("old_size")) & (F.col("head_hash") == F.col("old_prefix")), "appended")
        .when(F.col("size") < F.col("old_size"), "truncated")
        .otherwise("rewritten")
    )
    generation = F.coalesce("old_generation", F.lit(0)) + F.when(F.col("change").isin("rewritten", "truncated"), 1).otherwise(0)
    return joined.withColumn("change", change).withColumn("generation", generation.cast("int")).drop("old_size", "old_full", "old_prefix", "old_generation")


def to_parse(changes: DataFrame) -> DataFrame:
    return changes.where("change <> 'unchanged'")


def newest_change(changes: DataFrame) -> DataFrame:
    """The last change of each path in a batch: a burst is one piece of work."""
    return changes.groupBy("path").agg(F.max(F.struct("mtime_ms", "size")).alias("last")).select("path", "last.mtime_ms", "last.size")


def changed_files(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """A stream of a folder's files as binary rows; a file is listed again when its name is new.

    Appended files keep their names, so writers of a watched folder announce them
    in a manifest stream (see ``follow``), and this source serves new files.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def follow(manifests: DataFrame, read: Callable[[list[str]], DataFrame], ingest: Callable[[DataFrame], None], checkpoint: str, most_files: int = 256, once: bool = True):
    """Re-reads every announced file once for each micro-batch and hands it on.

    ``manifests`` is a stream of (path, mtime_ms, size).  A path announced many
    times in one batch is read once; ids are derived from content, so a batch that
    runs again replaces its own rows.
    """

    def batch(rows: DataFrame, _: int) -> None:
        paths = newest_change(rows).orderBy(F.desc("mtime_ms"))
        # paths alone come to the driver, in portions
        portion: list[str] = []
        for row in paths.toLocalIterator():
            portion.append(row.path)
            if len(portion) == most_files:
                ingest(read(portion))
                portion = []
        if portion:
            ingest(read(portion))

    writer = manifests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def debounced(changes: DataFrame, quiet: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """A stream's bursts of changes (path, ts): one row when a path has been quiet."""
    return changes.withWatermark("ts", late).groupBy("path", F.session_window("ts", quiet).alias("burst")).agg(F.count("*").alias("events"), F.max("ts").alias("last"))


def upsert(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that replaces rows by key."""

    def batch(rows: DataFrame, _: int) -> None:
        write(replaced_by_key(read(), rows, key))

    return batch


def is_oversized(size: Column, most: int = 64 << 20) -> Column:
    return size > most
