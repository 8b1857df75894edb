"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode, where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = f"file://{tempfile.mkdtemp(prefix='transcripta-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Lists that take the paths of tables as they are settled.
_watching: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables that are settled inside the block."""
    made: list[str] = []
    _watching.append(made)
    try:
        yield made
    finally:
        # by identity: nested blocks may hold equal lists
        _watching[:] = [x for x in _watching if x is not made]


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Deletes settled tables that nothing will read again."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside the block, Arrow batches that tasks are given hold so many rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries that are run inside the block delete their shuffle files as they end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is a scan of fewer parts, such as one file of one row group."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # dealt out already
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: no lineage, no loss with an executor.

    The folder is scratch space of the session: nothing in it is needed when a
    query's result has been written.  The shuffle files that made the table go.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _watching:
        made.append(path)
    with swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
