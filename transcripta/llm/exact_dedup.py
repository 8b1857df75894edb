"""Exact dedup: counting quotient filters find repeated fingerprints, bytes decide.

Texts are equal when they are identical after lower-casing A-Z.  A text's fingerprint
is the leading bits of its SHA-256.  Each partition builds counting quotient filters of
its fingerprints, one for each shard (the fingerprint's top bits): the next bits, the
quotient, name a home slot, the rest, the remainder, is stored in the run of its
quotient, in order, moved on where slots are taken.  Three bits a slot's place say
which quotients have a run, where runs end, and which slots hold a counter instead: a
remainder that occurs more than once is followed by its count.  Filters of any sizes
merge without loss: reading one gives whole fingerprints in order, with counts, and a
merged filter is built from the union, with as many slots as it then needs.

Documents whose fingerprint the merged filters count more than once are read again, and
only they are shuffled with their texts, to be grouped by all their bytes; copies
collapse before that shuffle.  A bitmap of fixed size tells tasks which fingerprints
those are; it only spares work.  Of equal texts the row with the largest id stays.

A null text counts as empty.  Ids are whole numbers; rows with a null id are members of
their group and stay only where no other does.  Rows that repeat both id and text count
as two, and one of them stays.  An empty table has an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bitmap, bitmap_holds, settled, tidy
from .wordhash import LOWER

#: Bits of a fingerprint; fewer make collisions, which cost work and no rows.
BITS = 64
#: Share of the home slots that a new filter fills at most.
LOAD = 0.9
#: No more groups than this are broadcast: those with over 1 / HOT of all rows each.
HOT = 4096
#: Bytes of texts that are lowered at a time.
LOWERED = 1 << 22

_HEADER = np.dtype([("quotient_bits", "<u1"), ("remainder_bytes", "<u1"), ("slots", "<u8")])


def _widths(entries: int, bits: int) -> tuple[int, int]:
    """(quotient bits, remainder bytes) of a filter for so many fingerprints of ``bits`` bits."""
    quotient = min(bits, max(3, int(np.ceil(np.log2(max(entries, 1) / LOAD)))))
    return quotient, (bits - quotient + 7) // 8 or 1


def filter_of(prints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of distinct sorted fingerprints of ``bits`` bits, and their counts."""
    quotient_bits, width = _widths(len(prints), bits)
    rest = np.uint64(bits - quotient_bits)
    home = (prints >> rest).astype(np.int64)
    many = counts > 1
    # a counter has to fit its slot
    width = max(width, (int(counts.max(initial=1)).bit_length() + 7) // 8)
    taken = 1 + many
    before = np.cumsum(taken) - taken
    # a slot is home, or the next free one after the entries before it
    start = before + np.maximum.accumulate(home - before) if len(prints) else before
    slots = max(1 << quotient_bits, int(start[-1] + taken[-1]) if len(prints) else 0)
    values = np.zeros(slots, dtype="<u8")
    values[start] = prints & ((np.uint64(1) << rest) - np.uint64(1))
    values[start[many] + 1] = counts[many]
    marks = np.zeros((3, slots), dtype=bool)
    marks[0, home] = True
    last = np.ones(len(prints), dtype=bool)
    last[:-1] = home[1:] != home[:-1]
    marks[1, (start + taken - 1)[last]] = True
    marks[2, start[many] + 1] = True
    head = np.array([(quotient_bits, width, slots)], dtype=_HEADER).tobytes()
    return head + np.packbits(marks, axis=1).tobytes() + values.view(np.uint8).reshape(slots, 8)[:, :width].tobytes()


def entries_of(raw: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a filter in order, and their counts."""
    head = np.frombuffer(raw, dtype=_HEADER, count=1)[0]
    slots, width, quotient_bits = int(head["slots"]), int(head["remainder_bytes"]), int(head["quotient_bits"])
    row = (slots + 7) // 8
    marks = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=_HEADER.itemsize, count=3 * row).reshape(3, row), axis=1, count=slots).astype(bool)
    values = np.zeros((slots, 8), dtype=np.uint8)
    values[:, :width] = np.frombuffer(raw, dtype=np.uint8, offset=_HEADER.itemsize + 3 * row).reshape(slots, width)
    values = values.view("<u8").ravel().astype(np.uint64)
    home, end = np.flatnonzero(marks[0]), np.flatnonzero(marks[1])
    if not len(home):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    # a run begins at its home, or where the run before it ends
    begin = np.maximum(home, np.concatenate([[0], end[:-1] + 1]))
    size = end - begin + 1
    used = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
    quotient = np.repeat(home, size)
    counter = marks[2, used]
    at = used[~counter]
    prints = (quotient[~counter].astype(np.uint64) << np.uint64(bits - quotient_bits)) | values[at]
    counts = np.ones(len(at), dtype=np.int64)
    followed = np.zeros(slots + 1, dtype=bool)
    followed[used[counter]] = True
    counted = followed[at + 1]
    counts[counted] = values[at[counted] + 1].astype(np.int64)
    return prints, counts


def _summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.ones(len(prints), dtype=bool)
    first[1:] = prints[1:] != prints[:-1]
    at = np.flatnonzero(first)
    return prints[at], np.add.reduceat(counts, at) if len(at) else counts


def _built(batches: Iterator[pa.RecordBatch], bits: int, shard_bits: int) -> Iterator[pa.RecordBatch]:
    """(shard, filter): the filters of a partition's fingerprints."""
    parts = [batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for batch in batches]
    if parts:
        prints = np.concatenate(parts)
        prints, counts = _summed(prints, np.ones(len(prints), dtype=np.int64))
        shards = (prints >> np.uint64(bits - shard_bits)).astype(np.int64)
        prints &= (np.uint64(1) << np.uint64(bits - shard_bits)) - np.uint64(1)
        found, first = np.unique(shards, return_index=True)
        edges = np.append(first, len(prints))
        filters = (filter_of(prints[a:b], counts[a:b], bits - shard_bits) for a, b in zip(edges[:-1], edges[1:]))
        yield pa.RecordBatch.from_pydict({"shard": pa.array(found, pa.int32()), "filter": pa.array(filters, pa.binary())})


def shard_bits_of(docs: DataFrame) -> int:
    """Shards grow with the parts that the session shuffles in, so one fits a task."""
    return min(16, max(4, (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def filters(prints: DataFrame, shard_bits: int, bits: int = BITS) -> DataFrame:
    """(shard, filter) of each partition of ``prints`` (fingerprint)."""
    return prints.select("fingerprint").mapInArrow(partial(tidy, partial(_built, bits=bits, shard_bits=shard_bits)), "shard int, filter binary")


def merged(parts: DataFrame, shard_bits: int, bits: int = BITS) -> DataFrame:
    """One filter for each shard: also of filters that were stored before, and of a later batch's."""

    def joined(table: pa.Table) -> pa.Table:
        read = [entries_of(raw.as_py(), bits - shard_bits) for raw in table["filter"]]
        prints, counts = _summed(np.concatenate([p for p, _ in read]), np.concatenate([c for _, c in read]))
        return pa.table({"shard": table["shard"].slice(0, 1), "filter": pa.array([filter_of(prints, counts, bits - shard_bits)], pa.binary())})

    return parts.groupBy("shard").applyInArrow(joined, "shard int, filter binary")


def repeated(found: DataFrame, shard_bits: int, bits: int = BITS) -> DataFrame:
    """(fingerprint, n) of those that the filters count more than once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                prints, counts = entries_of(raw.as_py(), bits - shard_bits)
                prints = (prints | (np.uint64(shard) << np.uint64(bits - shard_bits)))[counts > 1]
                yield pa.RecordBatch.from_pydict({"fingerprint": pa.array(prints.view(np.int64), pa.int64()), "n": pa.array(counts[counts > 1], pa.int64())})

    return found.select("shard", "filter").mapInArrow(partial(tidy, read), "fingerprint bigint, n bigint")


def _normal(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes], np.ndarray]]:
    """Rows of (id, text) with the texts lowered, their SHA-256 and their fingerprints, some MB at a time."""
    for whole in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False))
        low = 0
        while low < whole.num_rows:
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + LOWERED, side="right")))
            batch = whole.slice(low, high - low)
            texts = [(x.as_buffer() or pa.py_buffer(b"")).to_pybytes().translate(LOWER.tobytes()) for x in batch.column(1)]
            digests = [hashlib.sha256(x).digest() for x in texts]
            prints = np.frombuffer(b"".join(digests), dtype=">u8")[::4].astype(np.uint64) >> np.uint64(64 - bits)
            yield batch, texts, digests, prints
            low = high


def _addressed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch, _, digests, prints in _normal(batches, bits):
        yield pa.RecordBatch.from_pydict({"id": batch.column(0), "digest": pa.array(digests, pa.binary()), "fingerprint": pa.array(prints.view(np.int64), pa.int64())})


def _routed(batches: Iterator[pa.RecordBatch], bits: int, wanted) -> Iterator[pa.RecordBatch]:
    held = np.frombuffer(wanted.value, dtype=np.uint8)
    for batch, texts, digests, prints in _normal(batches, bits):
        at = np.flatnonzero(bitmap_holds(held, prints))
        yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(at, pa.int64())), "digest": pa.array([digests[k] for k in at], pa.binary()), "text": pa.array([texts[k] for k in at], pa.binary())})


def _holding(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    held = np.frombuffer(wanted.value, dtype=np.uint8)
    for batch in batches:
        keep = bitmap_holds(held, batch.column("fingerprint").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keep)], names=[*batch.schema.names[:-1], "held"])


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    shard_bits = min(shard_bits_of(docs), bits - 1)
    facts = rows.mapInArrow(partial(tidy, partial(_addressed, bits=bits)), "id bigint, digest binary, fingerprint bigint")
    # the number tells rows of one id and text apart, and is fixed by being written
    facts = settled(facts.withColumn("row", F.monotonically_increasing_id()), "copies-facts")
    found = settled(merged(filters(facts, shard_bits, bits), shard_bits, bits), "copies-filters")
    wanted = spark.sparkContext.broadcast(bitmap(repeated(found, shard_bits, bits), "fingerprint"))

    routed = rows.mapInArrow(partial(tidy, partial(_routed, bits=bits, wanted=wanted)), "id bigint, digest binary, text binary")
    # grouping compares whole texts; equal digests of different texts would come out as two rows
    groups = routed.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    groups = settled(groups.select("digest", "keep_id", "n"), "copies-groups")

    held = facts.select("id", "digest", "row", "fingerprint").mapInArrow(partial(tidy, partial(_holding, wanted=wanted)), "id bigint, digest binary, row bigint, held boolean")
    hot = F.col("n") > max(1, facts.count() // HOT)
    # at most HOT groups have so large a share of all rows
    joined = held.join(F.broadcast(groups.where(hot).select("digest", F.col("keep_id").alias("hot_id"), F.col("n").alias("hot_n"))), "digest", "left")
    asked, others = joined.where("held and hot_n is null"), joined.where("not held or hot_n is not null")
    asked = asked.join(groups.where(~hot), "digest", "left").select("id", "digest", "row", "keep_id", "n")
    joined = settled(asked.unionByName(others.select("id", "digest", "row", F.col("hot_id").alias("keep_id"), F.col("hot_n").alias("n"))), "copies-joined")

    first = joined.where("n is not null and id <=> keep_id").groupBy("digest").agg(F.max("row").alias("row")).select("row", F.lit(True).alias("stays"))
    some, alone = joined.where("n is not null and id <=> keep_id").join(first, "row", "left"), joined.where("n is null or not id <=> keep_id").withColumn("stays", F.col("n").isNull())
    every = some.unionByName(alone, allowMissingColumns=True)
    return every.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("stays", F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
