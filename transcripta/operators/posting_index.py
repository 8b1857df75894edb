"""A posting index in segments: adding documents writes their rows, dropping them writes their numbers.

A segment holds the postings of a batch of documents and never changes.  Documents that
are dropped or replaced stay in it, under tombstones, until segments of one size are
merged.  A list of segments and tombstones, one small file for each change, says what is
current; the newest complete one counts.

Documents lie in groups of ``GROUP``, of similar lengths.  A row holds a term's entries
of one group, the largest count among them and the smallest length for each occurrence,
which bound the score that any of its documents can reach.  A page of the best hits
reads those bounds first, scores the groups with the highest, and then only those groups
whose bound reaches the last score found.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import batches_of, dropped, noted, settled, spread, swept
from .search import K1, B, idf, phrase_of, scored, tokens

GROUP = 128
#: Words that are numbered and sorted at once; a longer text is one group.
MOST_WORDS = 1 << 17
#: Segments within a factor of TIER in size are of one tier; so many of them are merged.
TIER = 8
#: Groups that are scored before the bounds of the others are looked at.
FIRST_GROUPS = 8
#: Documents for each folder of terms, and the most folders.
BUCKET_DOCUMENTS, MOST_BUCKETS = 4096, 64

_ENTRY = "struct<did: bigint, tf: int, len: int, places: array<int>>"
_ROWS = f"group bigint, term string, n int, most int, span double, entries array<{_ENTRY}>"
_POSTINGS = f"bucket int, {_ROWS}"


@dataclass
class Segment:
    """``gone`` maps the names of tombstones that lie on the segment to (documents, tokens) that they take off it."""

    name: str
    number: int
    documents: int
    length: int
    buckets: int
    gone: dict[str, tuple[int, int]] = field(default_factory=dict)

    @property
    def left(self) -> int:
        return self.documents - sum(d for d, _ in self.gone.values())

    @property
    def left_length(self) -> int:
        return self.length - sum(n for _, n in self.gone.values())

    @property
    def tier(self) -> int:
        return max(0, (max(1, self.left) // 1000).bit_length() // (TIER.bit_length() - 1))


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of GROUP documents, and of fewer if they have more than MOST_WORDS words, so that long ones don't add up."""
    ends = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
    low, before = 0, 0
    while low < batch.num_rows:
        high = min(low + GROUP, max(low + 1, int(np.searchsorted(ends, before + MOST_WORDS, side="right"))))
        yield batch.slice(low, high - low)
        low, before = high, ends[high - 1]


def _grouped(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """Posting rows (group, term, n, most, span, entries) of (did, words) rows, GROUP documents at a time."""
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        for rows in _cut(batch):
            words = rows.column(1)
            sizes = np.diff(words.offsets.to_numpy())
            coded = words.flatten().dictionary_encode()
            codes = coded.indices.to_numpy()
            owner = np.repeat(np.arange(rows.num_rows), sizes)
            place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # stable: within a term by document, then by place
            order = np.argsort(codes, kind="stable")
            codes, owner, place = codes[order], owner[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])) if len(codes) else np.zeros(0, dtype=np.int64)
            tf = np.diff(np.append(first, len(codes)))
            length = sizes[owner[first]]
            term = codes[first]
            start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else first
            n = np.diff(np.append(start, len(term)))
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(codes)), pa.int32()), pa.array(place, pa.int32()))
            entries = pa.StructArray.from_arrays([rows.column(0).take(pa.array(owner[first])), pa.array(tf, pa.int32()), pa.array(length, pa.int32()), places], names=["did", "tf", "len", "places"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(term)), pa.int32()), entries)
            most = np.maximum.reduceat(tf, start) if len(start) else tf
            span = np.minimum.reduceat(length / tf, start) if len(start) else tf.astype(float)
            group = (number << 44) | (part << 22) | made
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), group)), coded.dictionary.take(pa.array(term[start])), pa.array(n, pa.int32()), pa.array(most, pa.int32()), pa.array(span, pa.float64()), lists], names=["group", "term", "n", "most", "span", "entries"])


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _followed(places: str, following: str, by: int) -> Column:
    """Those places that have ``following`` ``by`` tokens later."""
    return F.array_intersect(F.col(places), F.transform(following, lambda p: p - F.lit(by)))


class Index:
    """An index below ``path``; every change is committed at once, and readers see one list of segments."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # The list of segments

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _lists(self) -> list[int]:
        folder = self._at("lists")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()) if self._fs.exists(folder) else []

    def segments(self) -> list[Segment]:
        found = self._lists()
        if not found:
            return []
        stream = self._fs.open(self._at("lists", str(found[-1])))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Segment(**x) for x in json.loads(text)]

    def _commit(self, segments: list[Segment], number: int) -> None:
        """The list ``number``, renamed into place whole; one of two writers of a number fails."""
        made = self._at("lists", f".{uuid.uuid4().hex}")
        stream = self._fs.create(made, False)
        stream.write(json.dumps([vars(s) for s in segments]).encode())
        stream.close()
        target = self._at("lists", str(number))
        if self._fs.exists(target) or not self._fs.rename(made, target):
            self._fs.delete(made, False)
            raise RuntimeError(f"the index has been changed by another writer: {self.path}")

    # Changes

    def build(self, documents: DataFrame) -> Index:
        """An index of these documents (did, text) alone."""
        number = (self._lists() or [0])[-1] + 1
        self._commit([self._written(documents, number)], number)
        return self

    def add(self, documents: DataFrame) -> Index:
        """Adds documents and replaces those of their numbers: a new segment, and tombstones on the older ones."""
        number, older = (self._lists() or [0])[-1] + 1, self.segments()
        new = self._written(documents, number)
        self._buried(older, self._lengths(new).select("did"), number)
        self._commit(self._merged([*older, new], number), number)
        return self

    def without(self, dids: DataFrame) -> Index:
        """Drops documents (did); their postings stay unread until a merge or ``compacted``."""
        number, older = (self._lists() or [0])[-1] + 1, self.segments()
        self._buried(older, settled(dids.select("did").distinct(), "index-gone"), number)
        self._commit(self._merged(older, number), number)
        return self

    def compacted(self) -> Index:
        """One segment without tombstones, and no other file: dropped texts can't be read from it any more."""
        number, older = (self._lists() or [0])[-1] + 1, self.segments()
        self._commit([self._union(older, number)] if older else [], number)
        self.vacuum()
        return self

    def vacuum(self) -> None:
        """Deletes segments, tombstones and lists that the current list doesn't name."""
        current, last = self.segments(), self._lists()[-1]
        keep = {"segments": {s.name for s in current}, "gone": {g for s in current for g in s.gone}, "lists": {str(last)}}
        for kind, names in keep.items():
            if self._fs.exists(self._at(kind)):
                for status in self._fs.listStatus(self._at(kind)):
                    if status.getPath().getName() not in names:
                        self._fs.delete(status.getPath(), True)

    def _written(self, documents: DataFrame, number: int) -> Segment:
        name = f"{number}-{uuid.uuid4().hex}"
        documents = spread(documents)
        # cut once: the lengths that order the rows must not cut again
        words = documents.select(F.col("did").cast("long").alias("did"), F.explode(F.array(tokens(F.col("text")))).alias("words")).select("did", "words", F.size("words").alias("length"))
        with noted() as passing, swept(self.spark):
            words = settled(words.sortWithinPartitions("length", "did"), "index-words")
            words.select("did", F.col("length").cast("long").alias("length")).write.parquet(f"{self.path}/segments/{name}/lengths")
            count = self._counted(name)
            buckets = max(1, min(MOST_BUCKETS, count.documents // BUCKET_DOCUMENTS))
            rows = words.select("did", "words").mapInArrow(partial(_grouped, number=number), _ROWS)
            # a group at a time: rows are sorted by length, so a larger batch would hold a partition's longest texts together
            with batches_of(self.spark, GROUP):
                self._posted(rows, name, buckets)
        dropped(self.spark, passing)
        return Segment(name, number, count.documents, count.length or 0, buckets)

    def _counted(self, name: str):
        lengths = self.spark.read.parquet(f"{self.path}/segments/{name}/lengths")
        count = lengths.agg(F.count("*").alias("documents"), F.sum("length").alias("length"), F.count_distinct("did").alias("numbers")).first()
        if count.documents != count.numbers:
            raise ValueError("a document's number occurs twice in a batch")
        return count

    def _posted(self, rows: DataFrame, name: str, buckets: int) -> None:
        # a frequent term's groups spread over tasks
        spread = max(1, self.spark.sparkContext.defaultParallelism // buckets)
        self._stored(rows.repartition(_bucket(F.col("term"), buckets), F.pmod(F.xxhash64("group"), F.lit(spread))), name, buckets)

    def _stored(self, rows: DataFrame, name: str, buckets: int) -> None:
        """Rows as they are dealt out: sorted, so that statistics of pages prune."""
        rows = rows.withColumn("bucket", _bucket(F.col("term"), buckets)).sortWithinPartitions("bucket", "term", "group")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/segments/{name}/postings")

    def _lengths(self, segment: Segment) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{segment.name}/lengths")

    def _dead(self, segment: Segment) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/gone/{g}" for g in segment.gone))

    def _buried(self, segments: list[Segment], dids: DataFrame, number: int) -> None:
        """Puts tombstones for ``dids`` on the segments in which they live."""
        for segment in segments:
            live = self._lengths(segment)
            if segment.gone:
                live = live.join(self._dead(segment), "did", "left_anti")
            name = f"{number}-{uuid.uuid4().hex}"
            with swept(self.spark):
                live.join(dids, "did", "left_semi").write.parquet(f"{self.path}/gone/{name}")
            gone = self.spark.read.parquet(f"{self.path}/gone/{name}").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
            if gone.n:
                segment.gone[name] = (gone.n, gone.length)

    def _merged(self, segments: list[Segment], number: int) -> list[Segment]:
        """Empty segments go; where a tier has TIER segments, they become one."""
        segments = [s for s in segments if s.left]
        tiers: dict[int, list[Segment]] = {}
        for s in segments:
            tiers.setdefault(s.tier, []).append(s)
        for tier in sorted(tiers):
            if len(tiers[tier]) >= TIER:
                kept = [s for s in segments if s not in tiers[tier]]
                return self._merged([*kept, self._union(tiers[tier], number)], number)
        return segments

    def _union(self, segments: list[Segment], number: int) -> Segment:
        """One segment of the live rows of several: groups stay as they are, but for their dead documents."""
        name, rows, lengths, gone = f"{number}-{uuid.uuid4().hex}", None, None, None
        for s in segments:
            posted, own = self.spark.read.parquet(f"{self.path}/segments/{s.name}/postings").drop("bucket"), self._lengths(s)
            if s.gone:
                dead = self._gone(posted, s)
                gone, own = dead if gone is None else gone.unionByName(dead), own.join(self._dead(s), "did", "left_anti")
            rows = posted if rows is None else rows.unionByName(posted)
            lengths = own if lengths is None else lengths.unionByName(own)
        with swept(self.spark):
            lengths.write.parquet(f"{self.path}/segments/{name}/lengths")
            count = self._counted(name)
            buckets = max(1, min(MOST_BUCKETS, count.documents // BUCKET_DOCUMENTS))
            if gone is None:
                self._posted(rows, name, buckets)
            else:
                # postings are dealt out by group, once for the join and the files alike; a group belongs to one segment
                tasks = max(self.spark.sparkContext.defaultParallelism, buckets)
                self._stored(self._without(rows.repartition(tasks, "group"), gone.repartition(tasks, "group").hint("shuffle_hash")), name, buckets)
        return Segment(name, number, count.documents, count.length or 0, buckets)

    def _living(self, postings: DataFrame, segment: Segment) -> DataFrame:
        """Posting rows without their dead entries, counted and bounded anew.

        Rows keep their groups and stay whole: only the numbers in a group meet the dead.
        """
        return self._without(postings, self._gone(postings, segment))

    def _gone(self, postings: DataFrame, segment: Segment) -> DataFrame:
        """(group, gone) of the groups that hold dead documents."""
        held = postings.select("group", F.explode("entries.did").alias("did")).distinct()
        # a group has GROUP documents at most
        return held.join(self._dead(segment).select("did"), "did", "left_semi").groupBy("group").agg(F.collect_list("did").alias("gone"))

    def _without(self, postings: DataFrame, gone: DataFrame) -> DataFrame:
        rows = postings.join(gone, "group", "left")
        left = F.when(F.col("gone").isNull(), F.col("entries")).otherwise(F.filter("entries", lambda e: ~F.array_contains("gone", e["did"])))
        # a generator holds the filter back, which would look once for each use
        rows = rows.select("term", "group", F.explode(F.array(left)).alias("entries")).where(F.size("entries") > 0)
        return rows.select("term", "group", F.size("entries").alias("n"), F.array_max("entries.tf").alias("most"), F.array_min(F.transform("entries", lambda e: e["len"] / e["tf"])).alias("span"), "entries")

    # Reading

    def totals(self) -> tuple[int, float]:
        """The number of documents and their mean length; no table is read."""
        segments = self.segments()
        n = sum(s.left for s in segments)
        return n, sum(s.left_length for s in segments) / n if n else 0.0

    def _rows(self, words: list[str]) -> DataFrame:
        """The posting rows of some terms: folders by bucket, then pages by term."""
        out = None
        for s in self.segments():
            rows = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/segments/{s.name}/postings")
            # folded to constants before folders are listed
            rows = rows.where(F.col("bucket").isin(*(_bucket(F.lit(w), s.buckets) for w in words)) & F.col("term").isin(*words)).drop("bucket")
            if s.gone:
                rows = self._living(rows, s)
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], _POSTINGS).drop("bucket")

    def ranked(self, terms: list[str]) -> DataFrame:
        """(did, rank) of every document that holds every term."""
        phrases = [p for p in map(phrase_of, terms) if p]
        n, mean = self.totals()
        if not phrases or not n:
            return self.spark.createDataFrame([], "did bigint, rank double")
        rows = self._rows(sorted({w for p in phrases for w in p}))
        hits, counts = None, []
        for k, phrase in enumerate(phrases):
            found = self._phrase(rows, phrase).select("did", "len", F.col("tf").cast("long").alias(f"_tf{k}"))
            counts.append(found.agg(F.count("*").alias(f"_df{k}")))
            hits = found if hits is None else hits.join(found.drop("len"), "did")
        for count in counts:
            hits = hits.crossJoin(F.broadcast(count))  # one row
        hits = hits.withColumns({"_length": F.col("len").cast("long"), "_n": F.lit(n), "_mean": F.lit(mean)})
        return scored(hits, len(phrases)).select("did", "rank")

    def _phrase(self, rows: DataFrame, phrase: list[str]) -> DataFrame:
        """(did, len, tf) of the documents in which a phrase stands."""
        if len(phrase) == 1:
            return rows.where(F.col("term") == phrase[0]).select(F.inline(F.arrays_zip(*(F.col(f"entries.{c}").alias(c) for c in ("did", "len", "tf")))))
        starts = rows.where(F.col("term") == phrase[0]).select("group", F.inline("entries")).drop("tf")
        for k, word in enumerate(phrase[1:], 1):
            other = rows.where(F.col("term") == word).select("group", F.inline("entries")).select("group", "did", F.col("places").alias("next"))
            starts = starts.join(other, ["group", "did"]).select("group", "did", "len", _followed("places", "next", k).alias("places"))
        return starts.where(F.size("places") > 0).select("did", "len", F.size("places").alias("tf"))

    def best(self, terms: list[str], limit: int, after: float | None = None, digits: int | None = None) -> DataFrame:
        """(did, rank) of hits among which are the ``limit`` best and all that tie with the last of those.

        With ``after``, only hits of that rank or a worse one count.  With ``digits``, ranks
        are rounded to so many decimals, and those that are equal then tie.  A phrase's
        count of documents needs all its places, so phrases are ranked in full.
        """

        def cut(hits: DataFrame) -> DataFrame:
            hits = hits.select("did", "rank" if digits is None else F.round("rank", digits).alias("rank"))
            return hits if after is None else hits.where(F.col("rank") >= after)

        phrases = [p for p in map(phrase_of, terms) if p]
        n, mean = self.totals()
        if not phrases or not n or any(len(p) > 1 for p in phrases):
            return cut(self.ranked(terms))
        words = sorted({p[0] for p in phrases})
        rows = self._rows(words)
        heads = settled(rows.select("term", "group", "n", "most", "span"), "index-heads")
        held = {r.term: r.n for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term
        if len(held) < len(words):
            return self.spark.createDataFrame([], "did bigint, rank double")
        weight = F.create_map(*(F.lit(x) for w in words for x in (w, idf(n, held[w]) * sum(p[0] == w for p in phrases))))
        # a score grows with tf and with tf / len; the slack covers rounding
        bound = F.element_at(weight, F.col("term")) * F.lit((K1 + 1) * (1 + 1e-9)) / (1 + F.lit(K1 * (1 - B)) / F.col("most") + F.lit(K1 * B / mean) * F.col("span"))
        bounds = settled(heads.groupBy("group").agg(F.count("*").alias("terms"), F.sum(bound).alias("bound"), F.min("n").alias("n")).where(F.col("terms") == len(words)).select("group", "bound", "n"), "index-bounds")
        asked = -(-limit // GROUP) + FIRST_GROUPS
        first = [r.group for r in bounds.orderBy(F.desc("bound"), "group").limit(asked).collect()]

        def hits_of(groups: list[int] | DataFrame) -> DataFrame:
            some = rows.where(F.col("group").isin(*groups)) if isinstance(groups, list) else rows.join(groups, "group", "left_semi")
            each = some.select("term", F.inline(F.arrays_zip(*(F.col(f"entries.{c}").alias(c) for c in ("did", "len", "tf")))))
            tf = [F.max(F.when(F.col("term") == p[0], F.col("tf"))).cast("long").alias(f"_tf{k}") for k, p in enumerate(phrases)]
            hits = each.groupBy("did").agg(F.count("*").alias("terms"), F.max("len").cast("long").alias("_length"), *tf).where(F.col("terms") == len(words))
            hits = hits.withColumns({"_n": F.lit(n), "_mean": F.lit(mean), **{f"_df{k}": F.lit(held[p[0]]).cast("long") for k, p in enumerate(phrases)}})
            return cut(scored(hits, len(phrases)))

        found = hits_of(first).orderBy("rank").limit(limit).agg(F.max("rank").alias("last"), F.count("*").alias("n")).first() if first else None
        last = found.last if found and found.n == limit else None
        if last is None:
            return hits_of(bounds.select("group"))
        # a score may have been rounded up to the last one
        wanted = bounds.where(F.col("bound") >= -last - (0 if digits is None else 10.0**-digits)).select("group")
        # few groups are read by name, which prunes pages; many by a join
        some = [r.group for r in wanted.limit(1001).collect()]
        return hits_of(some if len(some) <= 1000 else wanted).where(F.col("rank") <= last)
