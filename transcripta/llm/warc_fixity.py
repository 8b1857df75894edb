"""Merkle fixity audit of two replicas of a web archive.

Pages become WARC response records in shards; a record's leaf entry is the digest of
its bytes.  A key's digest alone says in which of a shard's ``LEAVES`` ranges it
lies, so a lost record moves no other, and each replica's tree is built and stored
without the other: a range's entries, ordered by key, hash into its leaf, each
``FANOUT`` consecutive nodes into their parent up to the shard's root, and shard
roots on into the archive's root.  Two trees are compared from the root down: only
the children of nodes that differ are read at the next level, and only the records
of differing leaves are compared.  Byte offsets, in the order of keys, are counted in
the damaged shards alone.

Records of one key (id and address) in one replica are one entry, hashed in order
of their digests, so repeated rows are no damage and a lost repeat is.  A null id
or address is the empty string, a null page an empty payload.  Two empty replicas
have equal roots and no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled

FANOUT = 16
#: Ranges of a shard, by the digests of keys.
LEAVES = 256
#: Records of a shard, on average.
SHARD_RECORDS = 512


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC response record."""
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"), page_id, F.lit(">\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), payload, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def _records(pages: DataFrame, shards: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(shard, node, page_id, url, length, digest), one row for each key; ``node`` is the leaf."""
    rows = pages.select(F.coalesce(pages[id_col].cast("string"), F.lit("")).alias("page_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), pages[html_col].alias("html"))
    rows = rows.withColumn("bytes", record(F.col("page_id"), F.col("url"), F.col("html"))).withColumn("key", F.md5(F.concat("page_id", F.lit(" "), "url")))
    shard = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % shards).cast("int")
    node = F.conv(F.substring("key", 9, 2), 16, 10).cast("long") % LEAVES
    rows = rows.select(shard.alias("shard"), node.alias("node"), "page_id", "url", F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("digest"))
    # repeats are counted by digest first, so a key repeated without end is a few rows
    repeats = rows.groupBy("shard", "node", "page_id", "url", "digest").agg(F.count("*").alias("times"), F.sum("length").alias("length"))
    digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("digest", "times"))), lambda x: F.concat_ws(":", x["digest"], x["times"].cast("string"))), ",")
    return repeats.groupBy("shard", "node", "page_id", "url").agg(F.sum("length").alias("length"), F.sha2(digests, 256).alias("digest"))


def _hashed(rows: DataFrame, keys: list[str], order: Column, entry: Column) -> DataFrame:
    """One digest for each key, over its rows' entries in order."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), entry.alias("e")))), lambda x: x["e"]), ",")
    return rows.groupBy(*keys).agg(F.sha2(listed, 256).alias("digest"))


@dataclass
class Tree:
    """A replica's stored tree: its records, and levels from the leaves of all shards up to the archive's root."""

    records: DataFrame
    levels: list[DataFrame]

    def root(self) -> str | None:
        row = self.levels[-1].first()
        return row.digest if row else None


def tree(pages: DataFrame, shards: int, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Tree:
    """The tree of one replica; trees compare if they have the same number of shards."""
    records = settled(_records(pages, shards, id_col, url_col, html_col), "warc-records")
    entry = F.concat_ws(":", F.sha2(F.concat_ws("\n", F.col("page_id"), F.col("url")), 256), F.col("digest"))
    levels = [settled(_hashed(records, ["shard", "node"], F.struct("page_id", "url"), entry), "warc-nodes")]
    size = LEAVES
    while size > 1:
        size = -(-size // FANOUT)
        up = levels[-1].withColumn("up", F.floor(F.col("node") / FANOUT).cast("long"))
        levels.append(settled(_hashed(up, ["shard", "up"], F.col("node"), F.concat_ws(":", F.col("node").cast("string"), F.col("digest"))).withColumnRenamed("up", "node"), "warc-nodes"))
    while shards > 1:
        # above the shards' roots a node is a range of shards
        shards = -(-shards // FANOUT)
        up = levels[-1].withColumn("up", F.floor(F.col("shard") / FANOUT).cast("int"))
        levels.append(settled(_hashed(up, ["up"], F.col("shard"), F.concat_ws(":", F.col("shard").cast("string"), F.col("digest"))).select(F.col("up").alias("shard"), F.lit(0).cast("long").alias("node"), "digest"), "warc-nodes"))
    return Tree(records, levels)


def _differing(one: DataFrame, two: DataFrame, under: Column, above: DataFrame | None) -> DataFrame:
    """(shard, node) of the nodes whose digests differ or are missing, among the children of ``above``."""
    if above is not None:
        parents = above.select(F.struct("shard", "node").alias("up"))
        one, two = (side.withColumn("up", under).join(parents, "up", "left_semi") for side in (one, two))
    joined = one.select("shard", "node", F.col("digest").alias("a")).join(two.select("shard", "node", F.col("digest").alias("b")), ["shard", "node"], "full")
    return joined.where("not (a <=> b)").select("shard", "node")


def compared(one: Tree, two: Tree) -> DataFrame:
    """(shard, page_id, url, length, status) of the records in which the trees differ."""
    inner = _inner_levels()
    differing = None
    for k in reversed(range(len(one.levels))):
        # the levels above the shards' roots group shards, those below group nodes
        under = F.struct(F.floor(F.col("shard") / FANOUT).cast("int").alias("shard"), F.col("node")) if k >= inner else F.struct("shard", F.floor(F.col("node") / FANOUT).cast("long").alias("node"))
        differing = settled(_differing(one.levels[k], two.levels[k], under, differing), "warc-differing")
        if differing.isEmpty():
            break
    here, there = (t.records.join(differing, ["shard", "node"], "left_semi").select("shard", "page_id", "url", F.col("length").alias(f"length_{s}"), F.col("digest").alias(s)) for t, s in ((one, "a"), (two, "b")))
    joined = here.join(there, ["shard", "page_id", "url"], "full").where("not (a <=> b)")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return joined.select("shard", "page_id", "url", F.col("length_a").alias("length"), status.alias("status"))


def _inner_levels() -> int:
    """Levels below the shards' roots."""
    size, count = LEAVES, 0
    while size > 1:
        size, count = -(-size // FANOUT), count + 1
    return count


def audit(first: DataFrame, second: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_records: int = SHARD_RECORDS) -> DataFrame:
    """(shard, page_id, url, offset, length, status) of each damaged record.

    ``offset`` and ``length`` locate it in the first replica's shard (null where
    it has none); status is "changed", "missing" (from the second) or "extra".
    """
    shards = max(1, -(-max(first.count(), second.count()) // shard_records))
    one, two = (tree(pages, shards, id_col, url_col, html_col) for pages in (first, second))
    damaged = settled(compared(one, two), "warc-damaged")
    in_order = Window.partitionBy("shard").orderBy("page_id", "url").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.records.join(damaged.select("shard").distinct(), "shard", "left_semi").select("shard", "page_id", "url", (F.sum("length").over(in_order) - F.col("length")).alias("offset"))
    return damaged.join(placed, ["shard", "page_id", "url"], "left").select("shard", "page_id", "url", "offset", "length", "status")
