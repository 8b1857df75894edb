"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

Each text's set of n-grams is written in one global order: n-grams that few
texts have come first, by hash; frequent ones come last, by rising count.  Two
texts of Jaccard similarity t or more must meet in the heads of their ordered
sets, so heads alone make candidates.  The order is then cut into fragments; a
candidate pair's overlap is counted in each fragment apart, from the segments of
both sets that lie there, and the counts are summed per pair.  No task ever
holds a whole large set or a whole group of copies:

* texts of equal sets are one class from the first scan on (each task sends a
  class once), so copies never meet as pairs;
* each class is first verified against one leader, the smallest class that
  shares most of its head; classes already linked make no pairs among
  themselves, and only pairs across components remain as candidates.

Both steps lose no link between components: a pair is left out only if its
classes are connected already.

Nulls and texts without words have empty sets and link with nothing; a text of
fewer words than ``n`` is one n-gram.  Repeated rows of one id count as texts of
their own, the id takes the smallest component.  Rows with a null id take part
in no result.  Other columns are ignored, so clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import dropped, noted
from .shared import bitmap, bitmap_holds, components, settled, tidy
from .wordhash import ALNUM, SPACED, blocks, distinct, mixed, shingles

#: At most so many n-grams are kept as frequent (16 MB with their ranks); with
#: more, the least frequent of them are ordered by hash like the rest.
MOST_FREQUENT = 1 << 20
#: An n-gram is reported as frequent where a task sees it in so many texts among
#: those that it gathers.
SEEN = 2
#: Hashes that a task gathers before it counts them.
GATHERED = 3 << 20
#: Counts are compared up to here.
MOST_SEEN = 10_000
FRAGMENTS = 8

WORDS = {"spaced": SPACED, "alnum": ALNUM}


def _sets(batches, words: str, n: int):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for low, high, found in blocks(batch.column(1), WORDS[words]):
            hashes, first = distinct(*shingles(found, n), high - low)
            yield ids[low:high], hashes, first


def _class_ids(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each text's set, from two independent sums."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (hashes, mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
    one, two = (s[first[1:]] - s[first[:-1]] for s in sums)
    return mixed(one ^ mixed(two + np.diff(first).astype(np.uint64))).view(np.int64)


CLASS_SCHEMA = "doc_id long, n long, cls long, gram long, seen long"


def _classes(batches: Iterator[pa.RecordBatch], words: str, n: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, cls) for each text, and (gram, seen) for n-grams that this task meets often."""
    gathered, size, told = [], 0, set()
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "cls", "gram", "seen")])

    def counted():
        grams, seen = np.unique(np.concatenate(gathered), return_counts=True)
        often = seen >= SEEN
        none = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(grams[often].view(np.int64)), pa.array(seen[often].astype(np.int64))], schema=schema)

    for ids, hashes, first in _sets(batches, words, n):
        cls = _class_ids(hashes, first)
        none = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(first)), pa.array(cls), none, none], schema=schema)
        for d, c in enumerate(cls.tolist()):
            if c not in told:
                told.add(c)
                gathered.append(hashes[first[d] : first[d + 1]])
                size += len(gathered[-1])
        if size >= GATHERED:
            yield counted()
            gathered, size, told = [], 0, set()
    if gathered:
        yield counted()


class _Order:
    """Places in the global order: 0 for rare n-grams, a rising rank for frequent ones."""

    def __init__(self, grams: np.ndarray, ranks: np.ndarray):
        self.grams, self.ranks = grams, ranks
        # most n-grams are told apart from frequent ones by a table of their first bits
        self.maybe = np.zeros(1 << 24, dtype=bool)
        self.maybe[(grams >> np.uint64(40)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=np.int64)
        asked = np.flatnonzero(self.maybe[(hashes >> np.uint64(40)).astype(np.int64)])
        if len(asked):
            own = hashes[asked]
            at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            out[asked] = np.where(self.grams[at] == own, self.ranks[at], 0)
        return out


def _heads(batches, words: str, n: int, percent: int, sent) -> Iterator[pa.RecordBatch]:
    """(gram, cls, n, pos) of the head of each class's ordered set, once for each task.

    With a bitmap, only of the grams that it may hold.
    """
    grams, ranks, bits = sent.value
    order = _Order(grams, ranks)
    bits = None if bits is None else np.frombuffer(bits, dtype=np.uint8)
    told: set[int] = set()
    for _, hashes, first in _sets(batches, words, n):
        rank, cls = order(hashes), _class_ids(hashes, first)
        out, owner, sizes, places = [], [], [], []
        for d, c in enumerate(cls.tolist()):
            size = int(first[d + 1] - first[d])
            if not size or c in told:
                continue
            told.add(c)
            own, place = hashes[first[d] : first[d + 1]], rank[first[d] : first[d + 1]]
            if place.any():
                own = own[np.argsort(place, kind="stable")]
            own = own[: size - -(-percent * size // 100) + 1]
            at = np.arange(len(own))
            if bits is not None:
                at = np.flatnonzero(bitmap_holds(bits, own))
                own = own[at]
            out.append(own)
            places.append(at)
            owner.append(np.full(len(own), c))
            sizes.append(np.full(len(own), size))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["gram", "cls", "n", "pos"])


def _segments(batches, words: str, n: int, sent) -> Iterator[pa.RecordBatch]:
    """(cls, fragment, grams) of the classes that the bitmap may hold, from the texts that stand for them.

    Both bitmaps may hold more than they were given, so a class may come twice.
    """
    grams, ranks, *maps = sent.value
    order = _Order(grams, ranks)
    classes, texts = (np.frombuffer(x, dtype=np.uint8) for x in maps)
    told: set[int] = set()
    for ids, hashes, first in _sets(batches, words, n):
        cls = _class_ids(hashes, first)
        wanted = np.flatnonzero(bitmap_holds(classes, cls) & bitmap_holds(texts, ids) & (np.diff(first) > 0))
        rows = []
        for d in wanted.tolist():
            c = int(cls[d])
            if c in told:
                continue
            told.add(c)
            own = hashes[first[d] : first[d + 1]]
            fragment = np.where(order(own) > 0, FRAGMENTS - 1, (own >> np.uint64(32)) * np.uint64(FRAGMENTS - 1) >> np.uint64(32)).astype(np.int64)
            rows += [(c, f, own[fragment == f].view(np.int64)) for f in np.unique(fragment).tolist()]
        if rows:
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]), pa.int32()), pa.array(np.concatenate([r[2] for r in rows])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), lists], names=["cls", "fragment", "grams"])


class _Join:
    def __init__(self, texts: DataFrame, n: int, percent: int, words: str):
        self.texts, self.n, self.percent, self.words = texts, n, percent, words
        self.spark = texts.sparkSession
        scanned = settled(texts.mapInArrow(partial(tidy, _classes, words=words, n=n), CLASS_SCHEMA), "classes")
        self.members = scanned.where("cls is not null").select("doc_id", "n", "cls")
        often = scanned.where("gram is not null").groupBy("gram").agg(F.least(F.sum("seen"), F.lit(MOST_SEEN)).alias("seen"))
        often = settled(often, "often")
        # the lowest count at which the list keeps its bound; at most MOST_SEEN counts
        least, total = 0, 0
        for row in often.groupBy("seen").count().orderBy(F.desc("seen")).collect():
            total += row["count"]
            if total > MOST_FREQUENT:
                least = row.seen + 1
                break
        table = often.where(F.col("seen") >= least).toArrow()
        grams, seen = table["gram"].to_numpy().view(np.uint64), table["seen"].to_numpy()
        ranks = np.empty(len(grams), dtype=np.int64)
        ranks[np.lexsort((grams, seen))] = np.arange(1, len(grams) + 1)
        order = np.argsort(grams)
        self.frequent = (grams[order], ranks[order])

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, na, nb) whose summed overlap reaches the similarity."""
        ends = settled(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "ends")
        stand = self.members.join(ends, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
        sent = self.spark.sparkContext.broadcast((*self.frequent, bitmap(ends, "cls"), bitmap(stand, "doc_id")))
        segments = settled(self.texts.mapInArrow(partial(tidy, _segments, words=self.words, n=self.n, sent=sent), "cls long, fragment int, grams array<long>"), "segments")
        one = segments.select(F.col("cls").alias("a"), "fragment", F.col("grams").alias("ga"))
        two = segments.select(F.col("cls").alias("b"), "fragment", F.col("grams").alias("gb"))
        counted = pairs.join(one, "a").join(two, ["b", "fragment"]).select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("ga", "gb")).alias("common"))
        # the maximum is of equal numbers, where a class came twice
        counted = counted.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("common").alias("common"))
        summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
        return summed.where(F.expr(f"100 * common >= {self.percent} * (na + nb - common)"))

    def _heads(self, grams: DataFrame | None = None) -> DataFrame:
        sent = self.spark.sparkContext.broadcast((*self.frequent, None if grams is None else bitmap(grams, "gram")))
        return self.texts.mapInArrow(partial(tidy, _heads, words=self.words, n=self.n, percent=self.percent, sent=sent), "gram long, cls long, n long, pos long")

    def links(self) -> DataFrame:
        """Edges (a, b) between classes, whose components are those of all similar pairs."""
        # most heads hold grams that no other class has: their rows stop here
        several = self._heads().groupBy("gram").agg(F.count("*").alias("seen")).where("seen > 1")
        with noted() as passing:  # tables that nothing reads any more once their reader is settled
            heads = settled(self._heads(several), "heads").distinct()
        several = heads.groupBy("gram").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("gram")
        shared = settled(heads.join(several, "gram", "left_semi"), "heads")
        dropped(self.spark, passing)
        # a text that others were changed from has no grams of its own: the class
        # that shares most of its head leads those that it meets
        shares = shared.groupBy("cls").agg(F.count("*").alias("shares"))
        central = shared.join(shares, "cls").select("gram", "cls", "n", F.struct((F.col("shares") / F.col("n")).alias("part"), F.col("cls"), F.col("n")).alias("own"))
        leaders = central.groupBy("gram").agg(F.max("own").alias("leader"))
        led = central.select("gram", "cls", "n", "own").join(leaders, "gram").where("leader.part > own.part or leader.part = own.part and leader.cls > cls")
        led = led.groupBy("cls", "n", "leader").agg(F.count("*").alias("together"))
        # a leader that shares little of the head is unlikely to be similar; such a class is left to the pairs below
        led = led.where(F.expr(f"100 * least(n, leader.n) >= {self.percent} * greatest(n, leader.n) and 300 * together >= {100 - self.percent} * n"))
        led = led.groupBy("cls", "n").agg(F.max(F.struct("together", "leader")).alias("best"))
        with noted() as passing:
            similar = self.similar(settled(led.selectExpr("cls a", "best.leader.cls b", "n na", "best.leader.n nb"), "pairs")).select("a", "b")
        stars = settled(similar, "stars")
        dropped(self.spark, passing)
        whole = components(stars)

        heads = shared.join(whole.withColumnRenamed("node", "cls"), "cls", "left").select("gram", "cls", "n", "pos", F.coalesce("component", "cls").alias("component"))
        with noted() as passing:
            heads = settled(heads, "heads")
        mixed_grams = heads.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("gram")
        heads = heads.join(mixed_grams, "gram", "left_semi")
        # the smaller text of a pair has the shorter head: it must share more of itself
        needed = f"ceil({self.percent} * (na + nb) / {100 + self.percent}.0D)"
        one = heads.where(F.expr(f"pos <= n - ceil({2 * self.percent} * n / {100 + self.percent}.0D)")).selectExpr("gram", "cls a", "n na", "pos pa", "component ca")
        two = heads.selectExpr("gram", "cls b", "n nb", "pos pb", "component cb")
        close = f"(na < nb or na = nb and a < b) and 100 * na >= {self.percent} * nb and pa <= na - {needed} and pb <= nb - {needed}"
        met = settled(one.join(two, "gram").where(F.expr(f"ca <> cb and {close}")).select("a", "b", "na", "nb").distinct(), "met")
        dropped(self.spark, passing)
        # what isn't in the common part of both whole heads lies behind one of them
        whole_heads = shared.groupBy("cls").agg(F.collect_list("gram").alias("grams"))  # a head is a part of one text
        together = met.join(whole_heads.selectExpr("cls a", "grams ga"), "a").join(whole_heads.selectExpr("cls b", "grams gb"), "b").withColumn("together", F.size(F.array_intersect("ga", "gb")))
        behind = f"(ceil({self.percent} * nb / 100.0D) - 1)"
        pairs = settled(together.where(F.expr(f"together + {behind} >= {needed}")).select("a", "b", "na", "nb"), "pairs")
        return whole.selectExpr("node a", "component b").unionByName(self.similar(pairs).select("a", "b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, words: str = "alnum") -> DataFrame:
    """(id, n_shingles, component_id) of each id: the smallest id reachable by links.

    Two texts link when ``100 * |intersection| >= percent * |union|`` of their
    sets of distinct word ``n``-grams.  ``words`` is "alnum" or "spaced".
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    join = _Join(texts, n, percent, words)
    labels = components(join.links()).withColumnRenamed("node", "cls")
    members = join.members.join(labels, "cls", "left")
    label = F.when(F.col("n") > 0, F.coalesce("component", "cls"))
    members = members.select("doc_id", "n", label.alias("label"))
    # settled, so that a label of very many documents can be split in the join
    lowest = settled(members.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("lowest")), "lowest")
    out = members.join(lowest, "label", "left").groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("lowest", "doc_id")).alias("component_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")
