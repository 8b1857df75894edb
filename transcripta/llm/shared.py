"""What several operators need of the session: settled tables, bounded bitmaps, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import checkpoint_root, dropped, noted, settled

__all__ = ["bitmap", "bitmap_holds", "checkpoint_root", "components", "settled", "tidy"]

#: Positions of a bitmap(): 8 MB, however many keys it holds.
BITMAP_POSITIONS = 1 << 26


def tidy(step: Callable[..., Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch], **options) -> Iterator[pa.RecordBatch]:
    """``step`` over the batches of a partition; then the worker, which may idle for long, gives freed memory back."""
    yield from step(batches, **options)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bitmap(keys: DataFrame, column: str) -> bytes:
    """A bitmap of ``BITMAP_POSITIONS`` bits that holds every key's low bits.

    It only spares work: a key that isn't there is surely absent, any other may
    be.  Its size is fixed, so it may be sent to every task.
    """
    position = F.expr(f"pmod({column}, {BITMAP_POSITIONS}) + 1")
    found = keys.select(position.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    out = np.zeros(BITMAP_POSITIONS // 8, dtype=np.uint8)
    for row in found.collect():
        low = (row.bucket - 1) * 4096
        out[low : low + len(row.bits)] = np.frombuffer(row.bits, dtype=np.uint8)
    return out.tobytes()


def bitmap_holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.int64) & (BITMAP_POSITIONS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has columns a and b of one ordered type; nulls and loops are left
    out.  Returns (node, component): the smallest node reachable, for each node
    that has an edge.  Each step is a partially aggregated minimum and an
    equi-join, so a node with very many edges is split by the engine, and each
    round is settled in the shared folder, where the one before it goes.
    """
    with noted() as passing:
        links = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        with noted() as made:
            links = settled(small, "links")
        dropped(edges.sparkSession, passing)
        passing = made
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")
