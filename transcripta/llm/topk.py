"""Exact top-k inner products by norm-bucketed retrieval.

Each task orders its vectors by length and cuts them into buckets.  A query
meets the buckets from the longest vectors on and carries the k-th best score so
far.  From that score and a bucket's longest vector follows a local cosine
threshold: above one, the bucket and all after it are skipped; low ones prune by
length (only the bucket's prefix of long enough vectors is multiplied); high
ones prune by coordinates (products over the query's largest coordinates plus a
bound from the remaining lengths).  What is left is verified by exact products.

Queries go to the tasks in blocks of at most ``QUERY_BLOCK`` rows and ``QUERY_BYTES``,
each block a pass of its own whose results are settled, so what is sent, what the
driver holds and the plan have a fixed bound.  A task returns k rows for each query
and group of vectors, and the k best are merged with one window.  A task's vectors
are ordered in groups of at most ``LOADED_BYTES``.

Components become floor(scale * x) as integers.  Vectors that are null or hold
null or non-finite components take no part, nor do rows with a null id.  Vectors
of different lengths have no product and are no candidates for each other.
Repeated rows are candidates of their own and one query; queries that share an id
share one ranking; a query's own id is never its candidate.  Scores are compared as
64-bit integers; vectors whose products could pass them raise an error.  Ties go to
the smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoint_root, tidy

QUERY_BLOCK = 16_384
QUERY_BYTES = 16 << 20
BUCKET = 1024
#: Bytes of vectors, as doubles, that a task orders by length at a time.
LOADED_BYTES = 32 << 20
#: From this local cosine threshold on, coordinates prune better than lengths.
STEEP = 0.4
#: Of the query's coordinates, so many are multiplied first.
FOCUS = 16

_OUT = "query_id long, vec_id long, score long"


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors) of equal length, in groups of about LOADED_BYTES."""
    held: dict[int, list] = {}
    for batch in batches:
        vectors = batch.column(1)
        lengths = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for size in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == size)
            rows = flat.reshape(-1, size) if len(of) == len(lengths) and size else flat[starts[of][:, None] + np.arange(size)]
            own = held.setdefault(size, [[], [], 0])
            own[0].append(ids[of])
            own[1].append(rows)
            own[2] += len(of)
            if own[2] * max(1, size) * 8 >= LOADED_BYTES:
                yield np.concatenate(own[0]), np.concatenate(own[1])
                del held[size]
    for ids, rows, _ in held.values():
        yield np.concatenate(ids), np.concatenate(rows)


def _exact(rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Integer products; doubles hold them exactly while they stay below 2**53."""
    return (rows @ query).astype(np.int64) if exact else rows.astype(np.int64) @ query.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _retrieved(ids, rows, norms, query_id, query, k, exact):
    """The k best of one loaded group for one query."""
    own = float(np.sqrt(query @ query))
    scores, found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    least = -np.inf
    focus = np.argsort(-np.abs(query), kind="stable")[:FOCUS]
    rest = float(np.sqrt(max(0.0, query @ query - query[focus] @ query[focus])))
    slack = 1e-6 * max(1.0, own * (norms[0] if len(norms) else 0.0))
    for low in range(0, len(ids), BUCKET):
        longest = norms[low]
        if own * longest < least - slack:
            break
        high = min(low + BUCKET, len(ids))
        local = least / (own * longest) if own * longest > 0 else -np.inf
        if local > 0:
            # by length: only so many of the bucket's vectors are long enough
            high = low + int(np.searchsorted(-norms[low:high], -(least - slack) / own, side="right"))
        part, names = rows[low:high], ids[low:high]
        if local >= STEEP and rows.shape[1] > 2 * FOCUS:
            # by coordinates: what the others can add is bounded by their lengths
            near = part[:, focus]
            bound = near @ query[focus] + rest * np.sqrt(np.maximum(norms[low:high] ** 2 - np.einsum("ij,ij->i", near, near), 0.0))
            left = bound >= least - slack
            part, names = part[left], names[left]
        other = names != query_id
        part, names = part[other], names[other]
        if len(names):
            scores, found = _best(np.concatenate([scores, _exact(part, query, exact)]), np.concatenate([found, names]), k)
            if len(scores) == k:
                least = float(scores[-1])
    return scores, found


def _searched(batches: Iterator[pa.RecordBatch], sent, k: int, scale: int) -> Iterator[pa.RecordBatch]:
    queries = sent.value
    for ids, vectors in _loaded(batches):
        rows = np.floor(vectors.astype(np.float64) * scale)
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        order = np.lexsort((ids, -norms))
        ids, rows, norms = ids[order], rows[order], norms[order]
        out: list[tuple] = []
        for query_id, vector in queries:
            if len(vector) == rows.shape[1]:
                query = np.floor(np.asarray(vector, dtype=np.float64) * scale)
                most = float(np.sqrt(query @ query)) * (norms[0] if len(norms) else 0)
                if most >= 2.0**62:
                    raise OverflowError("products of these vectors pass 64 bits")
                exact = most < 2.0**52
                scores, found = _retrieved(ids, rows, norms, query_id, query, k, exact)
                out.append((np.full(len(found), query_id), found, scores))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[j] for x in out]), pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])


def _query_blocks(queries: DataFrame) -> Iterator[list[tuple[int, list[float]]]]:
    held, size = [], 0
    for row in queries.toLocalIterator():
        held.append((row.id, row.vector))
        size += 8 * len(row.vector)
        if len(held) >= QUERY_BLOCK or size >= QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer products."""
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("vector"))
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))

    rows = whole(vectors)
    blocks = _query_blocks(whole(queries).distinct())
    block, folder = next(blocks, []), None
    while True:
        sent, block = spark.sparkContext.broadcast(block), next(blocks, None)
        found = rows.mapInArrow(partial(tidy, _searched, sent=sent, k=k, scale=scale), _OUT)
        if block is None and folder is None:
            break
        # of several passes each is done before the next is sent
        folder = folder or f"{checkpoint_root(spark)}/top-k-{uuid.uuid4().hex}"
        found.write.mode("append").parquet(folder)
        sent.destroy()
        if block is None:
            found = spark.read.schema(_OUT).parquet(folder)
            break
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
