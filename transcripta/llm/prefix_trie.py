"""Prefix trie of conversations that share heads, without building their texts.

A conversation's turns stand in the order of ``turn``, nulls first; equal ones by the
SHA-256 of role and text.  Conversation c is rebuilt as the first h turns of its base
(c - c % 20) and its own turns after its first h, with h = crc32(c) % 4.

Sequences of turns have fingerprints in a monoid: a turn is four numbers below four
primes, a sequence the polynomial of its turns in four bases, and the fingerprint of
two joined sequences follows from theirs and the second's length.  So a rebuilt
prefix is worked out from the stored prefixes of two conversations; no rebuilt turn or
text is ever made.  The same product carries a conversation across partitions: turns
are sorted by range, each partition multiplies its own, and the products at partition
ends, one for each partition, are carried on.  No task holds a whole conversation.

Rebuilt prefixes of one depth and fingerprint are a node.  Equality is verified by the
stored turns that they refer to: turns of one hash are grouped by their bytes, and in
each node all members' last turns must be the same.  As prefixes one turn shorter are
verified likewise, equal fingerprints then mean equal sequences.  A clash starts again
with other bases.

Figures of subtrees need no descent.  The smallest member owns a node, and what it owns
is a suffix of its path, so each member adds to a node the tokens that it doesn't own
below it, its leaf if it owns one, and its child if it owns that.

Null roles and texts count as empty, rows without a conv_id take no part, rows that
repeat are turns of their own, other columns aren't read.  Ids are whole numbers.  An
empty table has an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bitmap, bitmap_holds, settled, tidy
from .wordhash import SPACED, blocks, mixed

#: Conversations of a block share the first one's head.
BLOCK = 20
#: Turns that a head may have at most.
HEAD = 3
#: No more conversations or nodes than this are broadcast: those with over 1 / HOT of all rows each.
HOT = 4096
#: Ids that are joined to one text at a time.
JOINED = 4096
_SHIFT = np.uint64(31)
_LOW = np.uint64((1 << 31) - 1)
_NODE = ["depth", "fa", "fb"]


@dataclass(frozen=True)
class Seed:
    """The four primes, and which bases below them."""

    number: int = 0
    primes: tuple[int, ...] = (2147483647, 2147483629, 2147483587, 2147483579)

    def lanes(self) -> tuple[np.ndarray, np.ndarray]:
        primes = np.array(self.primes, dtype=np.uint64)
        return primes, mixed(np.arange(1, 5, dtype=np.uint64) * np.uint64(7919) + np.uint64(1000003 * self.number)) % (primes - np.uint64(1)) + np.uint64(1)


ATTEMPTS = tuple(Seed(k) for k in range(4))


def _unpacked(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    return [part for x in (a.view(np.uint64), b.view(np.uint64)) for part in (x >> _SHIFT, x & _LOW)]


def _packed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(((x << _SHIFT) | y).view(np.int64) for x, y in (parts[:2], parts[2:]))


def _power(base: np.uint64, exponent: np.ndarray, prime: np.uint64) -> np.ndarray:
    out, square, left = np.ones(len(exponent), dtype=np.uint64), base, exponent.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % prime, out)
        square = square * square % prime
        left = left >> np.uint64(1)
    return out


def joined_prints(first: tuple, second: tuple, length: np.ndarray, seed: Seed) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of sequences joined to ones of ``length`` turns."""
    primes, bases = seed.lanes()
    parts = zip(_unpacked(*first), _unpacked(*second), primes, bases)
    return _packed([(x * _power(base, length, prime) + y) % prime for x, y, prime, base in parts])


def _turn_prints(digests: np.ndarray, seed: Seed) -> list[np.ndarray]:
    """Four numbers for each turn, from the two halves of its digest (n, 2)."""
    primes, _ = seed.lanes()
    return [x % prime for x, prime in zip((digests[:, 0] >> np.uint64(32), digests[:, 0] & np.uint64(0xFFFFFFFF), digests[:, 1] >> np.uint64(32), digests[:, 1] & np.uint64(0xFFFFFFFF)), primes)]


_TURN = "conv_id bigint, turn bigint, d0 bigint, d1 bigint, words bigint"


def _digests(role: pa.Array, text: pa.Array) -> np.ndarray:
    made = bytearray()
    for r, t in zip(role, text):
        r, t = (r.as_buffer() or pa.py_buffer(b"")).to_pybytes(), (t.as_buffer() or pa.py_buffer(b"")).to_pybytes()
        made += hashlib.sha256(b"%d:%s%s" % (len(r), r, t)).digest()[:16]
    return np.frombuffer(bytes(made), dtype=">u8").astype(np.uint64).reshape(-1, 2)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turn, d0, d1, words) of (conv_id, turn, role, text)."""
    for batch in batches:
        digests = _digests(batch.column(2), batch.column(3))
        words = np.concatenate([found.counts() for _, _, found in blocks(batch.column(3), SPACED)] or [np.zeros(0, dtype=np.int64)])
        d0, d1 = (pa.array(digests[:, k].view(np.int64)) for k in (0, 1))
        yield pa.RecordBatch.from_pydict({"conv_id": batch.column(0), "turn": batch.column(1), "d0": d0, "d1": d1, "words": pa.array(words, pa.int64())})


_PLACED = "part int, conv_id bigint, at bigint, d0 bigint, d1 bigint, words bigint, pa bigint, pb bigint, until bigint, final boolean"


def _multiplied(batches: Iterator[pa.RecordBatch], seed: Seed) -> Iterator[pa.RecordBatch]:
    """Places, prefix fingerprints and prefix words of a partition's sorted turns, counted from its own first."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    primes, bases = seed.lanes()
    primes, bases = primes.tolist(), bases.tolist()
    conv, at, until, prints, held = None, 0, 0, [0, 0, 0, 0], None
    for batch in batches:
        digests = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in (2, 3)], axis=1)
        hashes = np.stack(_turn_prints(digests, seed), axis=1).tolist()
        places, sums, made = [], [], []
        for key, words, turn in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), hashes):
            if key != conv:
                conv, at, until, prints = key, 0, 0, [0, 0, 0, 0]
            at += 1
            until += words
            prints = [(x * base + h) % prime for x, base, h, prime in zip(prints, bases, turn, primes)]
            places.append(at)
            sums.append(until)
            made.append(prints)
        if not places:
            continue
        a, b = _packed([np.array(x, dtype=np.uint64) for x in zip(*made)])
        n = len(places)
        rows = {"part": pa.array([part] * n, pa.int32()), "conv_id": batch.column(0), "at": pa.array(places, pa.int64()), "d0": batch.column(2), "d1": batch.column(3), "words": batch.column(4), "pa": pa.array(a), "pb": pa.array(b), "until": pa.array(sums, pa.int64()), "final": pa.array([False] * n)}
        if held is not None:
            yield held
        held = pa.RecordBatch.from_pydict(rows)
    if held is not None:
        final = np.zeros(held.num_rows, dtype=bool)
        final[-1] = True
        yield held.set_column(9, "final", pa.array(final))


def _carried(ends: list, seed: Seed) -> list[tuple]:
    """(part, conv_id, n, pa, pb, until) that the turns of a conversation begun in earlier parts have to add."""
    out, conv, run = [], None, (0, 0, 0, 0)
    for end in ends:
        if conv is not None:
            out.append((end.part, conv, *run))
        if end.conv_id == conv:
            prints = joined_prints(tuple(np.array([x]) for x in run[1:3]), tuple(np.array([x]) for x in (end.pa, end.pb)), np.array([end.at]), seed)
            run = (run[0] + end.at, *(int(x[0]) for x in prints), run[3] + end.until)
        else:
            conv, run = end.conv_id, (end.at, end.pa, end.pb, end.until)
    return out


def _print_udf(seed: Seed):
    """Column function: the fingerprint (a, b) of a sequence joined to another of n turns."""

    @F.pandas_udf("a bigint, b bigint")
    def joined(fa: pd.Series, fb: pd.Series, sa: pd.Series, sb: pd.Series, n: pd.Series) -> pd.DataFrame:
        a, b = joined_prints(tuple(x.to_numpy(np.int64) for x in (fa, fb)), tuple(x.to_numpy(np.int64) for x in (sa, sb)), n.to_numpy(np.int64), seed)
        return pd.DataFrame({"a": a, "b": b})

    return joined


def _less_udf(seed: Seed):
    """Column function: one fingerprint less another, number by number."""

    @F.pandas_udf("a bigint, b bigint")
    def less(fa: pd.Series, fb: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.DataFrame:
        primes, _ = seed.lanes()
        parts = zip(_unpacked(*(x.to_numpy(np.int64) for x in (fa, fb))), _unpacked(*(x.to_numpy(np.int64) for x in (sa, sb))), primes)
        a, b = _packed([(x + prime - y) % prime for x, y, prime in parts])
        return pd.DataFrame({"a": a, "b": b})

    return less


def _before_udf(seed: Seed):
    """Column function: the fingerprint of a sequence without its last turn."""

    @F.pandas_udf("a bigint, b bigint")
    def before(fa: pd.Series, fb: pd.Series, d0: pd.Series, d1: pd.Series) -> pd.DataFrame:
        primes, bases = seed.lanes()
        turn = _turn_prints(np.stack([x.to_numpy(np.int64).view(np.uint64) for x in (d0, d1)], axis=1), seed)
        inverse = [np.uint64(pow(int(base), -1, int(prime))) for base, prime in zip(bases, primes)]
        a, b = _packed([(x + prime - h) % prime * i % prime for x, h, prime, i in zip(_unpacked(*(x.to_numpy(np.int64) for x in (fa, fb))), turn, primes, inverse)])
        return pd.DataFrame({"a": a, "b": b})

    return before


def stored_turns(conversations: DataFrame, seed: Seed = ATTEMPTS[0]) -> DataFrame:
    """(conv_id, pos, d0, d1, words, pa, pb, until): each turn's place from 1, digest, words, and those of the prefix it ends."""
    spark = conversations.sparkSession
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hashed = rows.mapInArrow(partial(tidy, _hashed), _TURN)
    # unsigned order of the digests; rows that are equal in all stand in any order
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), *(F.col(d).bitwiseXOR(F.lit(-(1 << 63))) for d in ("d0", "d1"))]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ties are broken by chance, so that rows that repeat need not lie in one partition
    ranged = hashed.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    placed = settled(ranged.mapInArrow(partial(tidy, partial(_multiplied, seed=seed)), _PLACED), "trie-placed")
    # one row for each partition
    carried = _carried(placed.where("final").select("part", "conv_id", "at", "pa", "pb", "until").orderBy("part").collect(), seed)
    more = spark.createDataFrame(carried, "part int, conv_id bigint, more bigint, ca bigint, cb bigint, cuntil bigint")
    rows = placed.join(F.broadcast(more), ["part", "conv_id"], "left")
    out = rows.where("more is null").select("conv_id", F.col("at").alias("pos"), "d0", "d1", "words", "pa", "pb", "until")
    over = rows.where("more is not null").withColumn("p", _print_udf(seed)("ca", "cb", "pa", "pb", "at"))
    return settled(out.unionByName(over.select("conv_id", (F.col("at") + F.col("more")).alias("pos"), "d0", "d1", "words", F.col("p.a").alias("pa"), F.col("p.b").alias("pb"), (F.col("until") + F.col("cuntil")).alias("until"))), "trie-turns")


def joined_to(rows: DataFrame, one: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined to ``one`` row for each key, which says in ``n`` how many rows it will meet at most.

    Keys with more than a HOT-th of the ``total`` are few enough to be broadcast; no
    other key is large.
    """
    hot = F.col(n) > max(1, total // HOT)
    some = one.where(hot)
    marks = some.select(*on, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(marks), on, "left")
    return marked.where("_hot").drop("_hot").join(F.broadcast(some), on).unionByName(marked.where("_hot is null").drop("_hot").join(one.where(~hot), on))


_OF_HEAD = ("pa", "pb", "d0", "d1", "words", "until")


def _conversations(turns: DataFrame) -> DataFrame:
    """A row for each conversation: its number of turns, and its first HEAD turns' facts as pa1, pb1, ..."""
    heads = [F.max(F.when(F.col("pos") == i, F.col(c))).alias(f"{c}{i}") for i in range(1, HEAD + 1) for c in _OF_HEAD]
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("until").alias("total"), *heads)


def _at(place: Column, prefix: str, of: str) -> Column:
    """The fact of the prefix that ends at ``place`` (0: the empty one)."""
    out = F.lit(0).cast("long")
    for i in range(1, HEAD + 1):
        out = F.when(place == i, F.col(f"{prefix}{of}{i}")).otherwise(out)
    return out


def rebuilt(turns: DataFrame, seed: Seed = ATTEMPTS[0]) -> tuple[DataFrame, DataFrame]:
    """(paths, facts): a row for each rebuilt prefix, from the empty one, and a row for each conversation.

    A path's row holds conv_id, depth, the prefix's fingerprint (fa, fb), its last
    turn's digest (d0, d1) and words, the prefix's words (until), and the length of
    the whole; a conversation's its length and words.
    """
    own = settled(_conversations(turns), "trie-heads")
    base = own.select(F.col("conv_id").alias("base"), *(F.col(c).alias(f"b_{c}") for c in own.columns if c != "conv_id"))
    rows = own.withColumn("base", F.expr(f"conv_id - conv_id % {BLOCK}")).withColumn("h", F.expr(f"crc32(cast(cast(conv_id as string) as binary)) % {HEAD + 1}"))
    rows = rows.join(base, "base", "left").withColumn("k", F.least("h", F.coalesce("b_n", F.lit(0))))
    cut = F.least("h", "n")
    rows = rows.withColumns({"ea": _at(F.col("k"), "b_", "pa"), "eb": _at(F.col("k"), "b_", "pb"), "oa": _at(cut, "", "pa"), "ob": _at(cut, "", "pb"), "euntil": _at(F.col("k"), "b_", "until"), "ountil": _at(cut, "", "until")})
    rows = rows.withColumn("less", _less_udf(seed)("ea", "eb", "oa", "ob"))
    heads = [F.struct(F.lit(i).cast("long").alias("depth"), F.col(f"b_pa{i}").alias("fa"), F.col(f"b_pb{i}").alias("fb"), *(F.col(f"b_{c}{i}").alias(c) for c in ("d0", "d1", "words", "until"))) for i in range(1, HEAD + 1)]
    # whole rows, so that the join and the column function run once
    length = F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))
    moved = F.col("euntil") - F.col("ountil")
    whole = F.when(F.col("n") > F.col("h"), F.col("total") + moved).otherwise(F.col("euntil"))
    facts = settled(rows.select("conv_id", "n", "h", "k", "less.a", "less.b", moved.alias("moved"), length.alias("length"), whole.alias("whole"), F.array(*heads).alias("heads")), "trie-facts")
    shared = facts.select("conv_id", "k", "length", F.explode("heads").alias("head")).where("head.depth <= k").select("conv_id", "head.*", "length")
    after = joined_to(turns, facts.select("conv_id", "n", "h", "k", "a", "b", "moved", "length"), ["conv_id"], "n", turns.count()).where("pos > h")
    after = after.withColumn("p", _print_udf(seed)("a", "b", "pa", "pb", F.col("pos") - F.col("h")))
    suffix = after.select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), F.col("p.a").alias("fa"), F.col("p.b").alias("fb"), "d0", "d1", "words", (F.col("until") + F.col("moved")).alias("until"), "length")
    root = facts.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in suffix.columns[1:-1]), "length")
    return settled(shared.unionByName(suffix).unionByName(root), "trie-paths"), facts.select("conv_id", "length", "whole")


def _alike(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    held = np.frombuffer(wanted.value, dtype=np.uint8)
    for batch in batches:
        digests = _digests(batch.column(0), batch.column(1))
        at = pa.array(np.flatnonzero(bitmap_holds(held, digests[:, 1])), pa.int64())
        found = digests[at.to_numpy()]
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].view(np.int64)), pa.array(found[:, 1].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["d0", "d1", "role", "text"])


def clashing_turns(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Digests (d0, d1) that stand for different turns: those that repeat are read again and grouped by their bytes."""
    several = turns.groupBy("d0", "d1").agg(F.count("*").alias("n")).where("n > 1")
    wanted = conversations.sparkSession.sparkContext.broadcast(bitmap(several, "d1"))
    rows = conversations.where("conv_id is not null").select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    texts = rows.mapInArrow(partial(tidy, partial(_alike, wanted=wanted)), "d0 bigint, d1 bigint, role string, text string")
    return texts.groupBy("d0", "d1", "role", "text").agg(F.count("*").alias("n")).groupBy("d0", "d1").agg(F.count("*").alias("kinds")).where("kinds > 1")


def _nodes(paths: DataFrame) -> DataFrame:
    """A row for each node: its owner, members, how many end in it, and its last turn."""
    turn = [f(c).alias(f"{name}_{c}") for c in ("d0", "d1") for name, f in (("low", F.min), ("high", F.max))]
    return paths.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("length")).alias("n_ends"), F.min("words").alias("words"), F.min("until").alias("until"), *turn)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, fa, fb, conv_id, ids): stretches of a node's sorted ids, joined by commas."""
    key, ids = None, []

    def stretch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": [key[0]], "fa": [key[1]], "fb": [key[2]], "conv_id": [ids[0]], "ids": [",".join(map(str, ids))]}, schema=schema)

    schema = pa.schema([("depth", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("conv_id", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        for *here, conv in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if here != key or len(ids) == JOINED:
                if ids:
                    yield stretch()
                key, ids = here, []
            ids.append(conv)
    if ids:
        yield stretch()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, fa, fb, ends_sha256) of sorted stretches; a hash is all that a task holds of a node."""
    key, made = None, None
    out: list[tuple] = []
    schema = pa.schema([("depth", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("ends_sha256", pa.string())])

    def handed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for *here, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
            if here == key:
                made.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, made.hexdigest()))
            key, made = here, hashlib.sha256(ids.encode())
        if len(out) > 4096:
            yield handed()
    if key is not None:
        out.append((*key, made.hexdigest()))
    yield handed()


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, fa, fb, ends_sha256) of the nodes in which conversations end."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges split a node of very many ends; its ids come together as few long stretches
    rows = ends.select(*_NODE, "conv_id").repartitionByRange(parts, *_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    stretches = rows.mapInArrow(partial(tidy, _listed), "depth bigint, fa bigint, fb bigint, conv_id bigint, ids string")
    return stretches.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "conv_id").mapInArrow(partial(tidy, _digested), "depth bigint, fa bigint, fb bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, attempts: Sequence[Seed] = ATTEMPTS) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    for k, seed in enumerate(attempts):
        turns = stored_turns(conversations, seed)
        if k == 0 and not clashing_turns(conversations, turns).isEmpty():
            raise ArithmeticError("two different turns have one digest")
        paths, facts = rebuilt(turns, seed)
        nodes = settled(_nodes(paths), "trie-nodes")
        if nodes.where("low_d0 <> high_d0 or low_d1 <> high_d1").isEmpty():
            return _figures(paths, facts, nodes, seed)
    raise ArithmeticError(f"fingerprints of different prefixes met in {len(attempts)} attempts")


def _figures(paths: DataFrame, facts: DataFrame, nodes: DataFrame, seed: Seed) -> DataFrame:
    total = paths.count()
    # what a conversation owns: all from depth "since", behind so many words that it doesn't own; a childless node is a leaf
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.min(F.col("until") - F.col("words")).alias("unowned"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"))
    told = facts.join(owned, "conv_id", "left").select("conv_id", (F.col("length") + 1).alias("rows"), F.coalesce("since", F.col("length") + 1).alias("since"), F.coalesce("unowned", "whole").alias("unowned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    told = settled(told, "trie-told")
    met = joined_to(paths.select("conv_id", *_NODE, (F.col("until") - F.col("words")).alias("passed"), "length"), told, ["conv_id"], "rows", total)
    sums = met.groupBy(*_NODE).agg(
        F.sum(F.when(F.col("since") > F.col("depth"), F.col("unowned") - F.col("passed")).otherwise(0)).alias("saved_tokens"),
        F.sum("leaf").alias("n_leaves"),
        F.count_if((F.col("since") <= F.col("depth") + 1) & (F.col("length") > F.col("depth"))).alias("n_children"),
    )
    # an owner of the parent too is its name; the parents of the others are looked up
    known = nodes.join(told.select("conv_id", "since"), "conv_id")
    own = known.where("depth > since or depth = 0").select(*_NODE, "conv_id", "n_convs", F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id"))
    asked = known.where("depth = since and depth > 0").withColumn("p", _before_udf(seed)("fa", "fb", "low_d0", "low_d1"))
    asked = settled(asked.select(*_NODE, "conv_id", "n_convs", (F.col("depth") - 1).alias("up"), F.col("p.a").alias("ua"), F.col("p.b").alias("ub")), "trie-asked")
    parents = nodes.select(F.col("depth").alias("up"), F.col("fa").alias("ua"), F.col("fb").alias("ub"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("members"))
    found = joined_to(asked, parents, ["up", "ua", "ub"], "members", total).select(*_NODE, "conv_id", "n_convs", "parent_conv_id")
    out = own.unionByName(found).join(sums, _NODE).join(_ends(paths.where("depth = length")), _NODE, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
