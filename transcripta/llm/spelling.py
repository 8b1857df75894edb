"""Spelling variants: words one edit apart, each pointing at a far more frequent neighbour.

Words are the maximal runs of letters of whole texts (``[A-Za-z]`` and U+00C0 to
U+00FF), with A-Z lowered.  A stated fraction of (document, run) pairs loses one code
point, drawn by a hash of the two, so that the corpus holds variants.  Words of
``LEAST_LENGTH`` code points and ``LEAST_SEEN`` occurrences make the vocabulary.

Two words are near if one edit (a code point inserted, deleted or replaced) turns one
into the other.  Every word generates its deletions and, as nearness is symmetric,
its replacements by greater code points alone; no insertions are needed.  The edits'
hashes follow from the word's own, without building strings, and probe a blocked
Bloom filter of the vocabulary that is sharded by length: a key sets four bits in each
of two neighbouring 64-bit words.  Only edits that pass are built and shuffled to an
exact join with the vocabulary, which removes false positives.

A filter that is broadcast has at most ``FILTER_WORDS`` words of 64 bits (16 MB).  A
larger vocabulary makes more passes, each over the words that can meet its shards; a
length with more words than fit is cut into slices by hash.

A null text has no words; a null id is written as nothing before the colon.  Rows that
repeat count again.  Other columns are not read.  An empty table has an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled, tidy
from .wordhash import mixed

LEAST_LENGTH, LEAST_SEEN, TIMES = 7, 2, 10
#: One in so many (document, run) pairs is changed.
CHANGED = 31
#: 64-bit words of a broadcast filter, bits for each vocabulary word, and the length from which all share a shard.
FILTER_WORDS = 1 << 21
BITS_A_WORD = 24
LONG = 48
#: Distinct words that a task counts before it hands them on, characters that it scans and positions that it edits at a time.
HELD_WORDS = 1 << 17
SCANNED = 1 << 20
EDITED = 1 << 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LETTER = "a-zÀ-ÿ"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
_MET = pa.schema([("near", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _pieces(text: str, gap: re.Pattern) -> Iterator[str]:
    """``text`` in stretches of about SCANNED characters that end between words."""
    low = 0
    while low < len(text):
        found = gap.search(text, low + SCANNED) if low + SCANNED < len(text) else None
        high = found.end() if found else len(text)
        yield text[low:high]
        low = high


def _counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of (id, text) rows; a word may come more than once from one task."""
    # shorter runs make no word, and a maximal run is what a greedy match finds
    run, gap = re.compile(f"[{_LETTER}]{{{least},}}"), re.compile(f"[^{_LETTER}]")
    held: dict[str, int] = {}
    crc = zlib.crc32

    def handed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=_COUNTED)
        held.clear()
        return out

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            raw = text.as_buffer()
            if raw is None:
                continue
            runs: Counter[str] = Counter()
            for piece in _pieces(raw.to_pybytes().translate(_LOWER).decode(), gap):
                runs.update(run.findall(piece))
            before = crc(f"{key.as_py() or ''}:".encode())
            for word, n in runs.items():
                drawn = crc(word.encode(), before)
                if not drawn % CHANGED:
                    at = drawn % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < least:
                        continue
                held[word] = held.get(word, 0) + n
            if len(held) >= HELD_WORDS:
                yield handed()
    if held:
        yield handed()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_seen: int = LEAST_SEEN) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    counted = rows.mapInArrow(partial(tidy, partial(_counted, least=least_length)), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_seen)


class _Words:
    """A block of words as code points, with the sums that their edits' hashes are made of."""

    def __init__(self, words: list[str]):
        self.words = words
        joined = "".join(words).encode("latin-1")
        self.codes = np.frombuffer(joined, dtype=np.uint8)
        self.length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.first = np.cumsum(self.length) - self.length
        self.owner = np.repeat(np.arange(len(words)), self.length)
        self.place = np.arange(len(self.codes)) - self.first[self.owner]
        powers = np.full(int(self.length.max(initial=0)) + 1, _STEP)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        self.power = powers[self.place]
        self.mapped = _CODES[self.codes]
        self.term = self.mapped * self.power
        self.hash = np.add.reduceat(self.term, self.first) if len(words) else np.zeros(0, dtype=np.uint64)

    def without(self) -> np.ndarray:
        """The hash of each position's word without that position."""
        last = self.first + self.length - 1
        until = np.cumsum(self.term, dtype=np.uint64)
        before = until - self.term - (until - self.term)[self.first][self.owner]
        moved = np.cumsum(np.where(self.place > 0, self.mapped * np.concatenate([[np.uint64(1)], self.power[:-1]]), np.uint64(0)), dtype=np.uint64)
        return before + moved[last][self.owner] - moved


def _keys(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mixed(hashes + lengths.astype(np.uint64) * _SECOND)


def _mask(x: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)
    out = one << (x & low)
    for k in (6, 12, 18):
        out = out | (one << ((x >> np.uint64(k)) & low))
    return out


def _again(keys: np.ndarray) -> np.ndarray:
    return (keys * _SECOND) >> np.uint64(20)


class Plan:
    """Which slices of which length shards lie where in a pass's filter.

    ``blocks[shard]`` is the number of blocks of a slice, ``slices[shard]`` the number
    of slices, and ``at[shard][slice]`` the first block, or -1 in other passes.
    """

    def __init__(self, counts: dict[int, int], filter_words: int):
        most = filter_words // 2
        self.blocks, self.slices = np.zeros(LONG + 1, dtype=np.int64), np.ones(LONG + 1, dtype=np.int64)
        needed = {shard: max(1, math.ceil(n * BITS_A_WORD / 128)) for shard, n in sorted(counts.items())}
        for shard, blocks in needed.items():
            self.slices[shard] = math.ceil(blocks / most)
            self.blocks[shard] = min(most, math.ceil(blocks / self.slices[shard]))
        width = int(self.slices.max())
        self.passes: list[np.ndarray] = []
        filled = most
        for shard in needed:
            for part in range(self.slices[shard]):
                if filled + self.blocks[shard] > most:
                    self.passes.append(np.full((LONG + 1, width), -1, dtype=np.int64))
                    filled = 0
                self.passes[-1][shard, part] = filled
                filled += int(self.blocks[shard])

    def spots(self, at: np.ndarray, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """The block of each key in the pass ``at``, -1 where it isn't in this pass."""
        start = at[shards, 0] if at.shape[1] == 1 else at[shards, ((keys >> np.uint64(8)) % self.slices[shards].astype(np.uint64)).astype(np.int64)]
        block = ((keys >> np.uint64(32)) * self.blocks[shards].astype(np.uint64)) >> np.uint64(32)
        return np.where(start < 0, -1, start + block.astype(np.int64))


def _shard(lengths: np.ndarray) -> np.ndarray:
    return np.minimum(lengths, LONG)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, pa.RecordBatch]]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        low, held = 0, 0
        for high, word in enumerate(words):
            held += len(word)
            if held >= EDITED or high == len(words) - 1:
                yield _Words(words[low : high + 1]), batch.slice(low, high + 1 - low)
                low, held = high + 1, 0


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): how many words each length shard has, and which code points occur."""
    shards, codes = np.zeros(LONG + 1, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for words, _ in _blocks(batches):
        shards += np.bincount(_shard(words.length), minlength=LONG + 1)
        codes += np.bincount(words.codes, minlength=256)
    for kind, found in (("shard", shards), ("code", codes)):
        keys = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(keys), pa.string()), "key": pa.array(keys, pa.int64()), "n": pa.array(found[keys], pa.int64())})


def _bits(batches: Iterator[pa.RecordBatch], plan: Plan, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(at, bits): what each word sets in the filter of this pass."""
    for words, _ in _blocks(batches):
        keys = _keys(words.hash, words.length)
        spot = plan.spots(at, keys, _shard(words.length))
        keys, spot = keys[spot >= 0], spot[spot >= 0]
        where = np.concatenate([2 * spot, 2 * spot + 1])
        yield pa.RecordBatch.from_pydict({"at": pa.array(where, pa.int64()), "bits": pa.array(np.concatenate([_mask(keys), _mask(_again(keys))]).view(np.int64), pa.int64())})


def bloom(words: DataFrame, plan: Plan, at: np.ndarray, filter_words: int) -> np.ndarray:
    """The filter of one pass: at most ``filter_words`` words, however large the vocabulary."""
    found = words.mapInArrow(partial(_bits, plan=plan, at=at), "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(filter_words, dtype=np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _probed(batches: Iterator[pa.RecordBatch], bits, plan: Plan, at: np.ndarray, alphabet: list[int]) -> Iterator[pa.RecordBatch]:
    """(near, word, n): the edits of (word, n) rows that the filter lets pass."""
    filter_ = bits.value
    here = (at >= 0).any(axis=1)

    def passing(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        keys = _keys(hashes, lengths)
        spot = plan.spots(at, keys, _shard(lengths))
        mask = _mask(keys)
        left = np.flatnonzero((filter_[2 * spot] & mask == mask) & (spot >= 0))
        mask = _mask(_again(keys[left]))
        return left[filter_[2 * spot[left] + 1] & mask == mask]

    for words, batch in _blocks(batches):
        length = words.length[words.owner]
        near: list[str] = []
        owners = [np.zeros(0, dtype=np.int64)]
        # equal neighbours make one deletion
        other = np.ones(len(words.codes), dtype=bool)
        other[1:] = (words.codes[1:] != words.codes[:-1]) | (words.place[1:] == 0)
        tried = np.flatnonzero(other & here[_shard(length - 1)])
        if len(tried):
            tried = tried[passing(words.without()[tried], length[tried] - 1)]
            owners.append(words.owner[tried])
            near += (w[:p] + w[p + 1 :] for w, p in zip((words.words[k] for k in owners[-1].tolist()), words.place[tried].tolist()))
        rest = words.hash[words.owner] - words.term
        open_ = here[_shard(length)]
        for code in alphabet:
            tried = np.flatnonzero(open_ & (words.codes < code))
            if not len(tried):
                continue
            tried = tried[passing(rest[tried] + _CODES[code] * words.power[tried], length[tried])]
            owners.append(words.owner[tried])
            letter = chr(code)
            near += (w[:p] + letter + w[p + 1 :] for w, p in zip((words.words[k] for k in owners[-1].tolist()), words.place[tried].tolist()))
        picked = batch.take(pa.array(np.concatenate(owners), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(near, pa.string()), picked.column(0), picked.column(1)], schema=_MET)


def near_words(words: DataFrame, filter_words: int = FILTER_WORDS) -> DataFrame:
    """(word, n, near, near_n): each two words (word, n) that one edit turns into each other, both ways round.

    ``words`` are distinct, of code points below 256, and settled.
    """
    spark = words.sparkSession
    facts = words.mapInArrow(_facts, "kind string, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()  # a row for each length to LONG and each code point
    alphabet = sorted(r.key for r in facts if r.kind == "code")
    plan = Plan({r.key: r.n for r in facts if r.kind == "shard"}, filter_words)
    met = None
    for k, at in enumerate(plan.passes):
        bits = spark.sparkContext.broadcast(bloom(words, plan, at, filter_words))
        found = words.mapInArrow(partial(tidy, partial(_probed, bits=bits, plan=plan, at=at, alphabet=alphabet)), "near string, word string, n bigint")
        # settled pass by pass, so that one filter is held at a time
        found = settled(found, "spelling-met")
        bits.unpersist()
        met = found if met is None else met.unionByName(found)
    if met is None:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    pairs = met.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(both))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form).

    A form is ``TIMES`` times as frequent as its word, so chains are short and end.
    """
    chains = settled(forms.select("word", F.col("form").alias("root")), "spelling-chains")
    while True:
        step = forms.select(F.col("word").alias("root"), F.col("form").alias("_next"))
        moved = settled(chains.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-chains")
        chains = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return chains


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, filter_words: int = FILTER_WORDS, **options) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of the vocabulary.

    ``form`` is the near word of the largest n, the first in code-point order among
    equals, if that n is at least ``times`` the word's own.
    """
    words = vocabulary(docs, id_col, text_col, **options)
    # few bytes that cost much to edit: as many parts as the session shuffles in
    words = settled(words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word"), "spelling-words")
    near = settled(near_words(words, filter_words), "spelling-near")
    counts = near.groupBy("word").agg(F.count("*").alias("n_near"))
    # strings compare by their bytes, which is code-point order
    best = near.where(F.col("near_n") >= times * F.col("n")).groupBy("word").agg(F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    forms = settled(best.select("word", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "spelling-forms")
    out = words.join(counts, "word", "left").join(forms.join(rooted(forms), "word"), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
