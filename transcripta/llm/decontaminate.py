"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised words of all items go into one automaton.  Training words are
streamed through it; at each word the state gives the longest suffix that is a
run of item words.  A match of ``window`` words (or of a whole item that has
fewer) is a hit; hits are merged into spans, which are cut out, and a text whose
hit share passes ``most_coverage`` goes as a whole.

A match of ``window`` words needs ``window - 1`` consecutive word pairs that
occur in items.  Pairs are tested in numpy for all words of a block first, and
only runs long enough are streamed through the automaton: no match is lost, and
text without item passages costs no Python step per word.

Items go to the executors in blocks of about ``MOST_WORDS`` words, an automaton
each; a longer item is cut into pieces that overlap by all but one word of a window.
``TOGETHER`` blocks are one pass of one Python process for each task; a benchmark
of more makes further passes, each settled in the shared folder, so neither what is
sent, nor a task's memory, nor its processes grow with the benchmark.  No row is
shuffled.

Null and empty texts have no words, no hits and are kept as they are; null and
wordless items are no windows; items with a null id are left out; items that
share an id count as one.  Rows are treated one by one, so repeated rows and null
ids change nothing; other columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settled, tidy
from .wordhash import _BASE, ALNUM, Words, blocks, mixed, scanned

WINDOW = 10
#: Item words in one automaton: about 60 MB in a Python worker.
MOST_WORDS = 50_000
#: Automata that a pass holds at a time.
TOGETHER = 4
_PAIR_BITS = 22

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


class Automaton:
    """Generalised suffix automaton over words given by their hashes."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extended(last, word)
        self.owners: list[set[str]] = [set() for _ in self.step]
        self.short: dict[int, list[tuple[int, str]]] = {}
        self._at_window: dict[int, int] = {}
        for item, words in items:
            state = 0
            for word in words:
                state = self.step[state][word]
                up = state
                while up > 0 and item not in self.owners[up]:
                    self.owners[up].add(item)
                    up = self.link[up]
            if words and len(words) < window:
                self.short.setdefault(state, []).append((len(words), item))
        lengths = [min(len(words), window) for _, words in items if words]
        self.least = min(lengths, default=0)
        ids = np.array([w for _, words in items for w in words], dtype=np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(words) for _, words in items])
        self.pairs = np.zeros(1 << _PAIR_BITS, dtype=bool)
        self.singles = np.unique(ids)
        if len(ids):
            self.pairs[_pair_places(ids)[owner[1:] == owner[:-1]]] = True

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        clone = self._new(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = clone
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = clone
            state = self.link[state]
        return clone

    def _extended(self, last: int, word: int) -> int:
        target = self.step[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        fresh = self._new(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = fresh
            state = self.link[state]
        if state >= 0:
            target = self.step[state][word]
            self.link[fresh] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return fresh

    def _window_state(self, state: int) -> int:
        found = self._at_window.get(state)
        if found is None:
            found = state
            while self.length[self.link[found]] >= self.window:
                found = self.link[found]
            self._at_window[state] = found
        return found

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(from, to, items) of each window that ends at some word of ``words``."""
        state = length = 0
        for at, word in enumerate(words, 1):
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.step[state].get(word, 0)
            length = length + 1 if state else 0
            if length >= self.window:
                yield at - self.window, at, self.owners[self._window_state(state)]
            if self.short:
                up = state
                while up > 0:
                    for size, item in self.short.get(up, ()):
                        if size <= length:
                            yield at - size, at, {item}
                    up = self.link[up]

    def hits(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the items found in each text."""
        hit, found = np.zeros(len(words.hashes), dtype=bool), {}
        if not self.least or len(words.hashes) < self.least:
            return hit, found
        owner = np.repeat(np.arange(len(words.first) - 1), words.counts())
        if self.least == 1:
            starts, ends = _runs(np.isin(words.hashes, self.singles))
        else:
            known = self.pairs[_pair_places(words.hashes)] & (owner[1:] == owner[:-1])
            starts, ends = _runs(known)
            long = ends - starts >= self.least - 1
            starts, ends = starts[long], ends[long] + 1
        for low, high in zip(starts.tolist(), ends.tolist(), strict=True):
            if self.least == 1:
                cuts = [low, *(x for x in words.first.tolist() if low < x < high), high] if owner[low] != owner[high - 1] else [low, high]
            else:
                cuts = [low, high]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for begin, end, items in self.matches(words.hashes[a:b].tolist()):
                    hit[a + begin : a + end] = True
                    found.setdefault(int(owner[a]), set()).update(items)
        return hit, found


def _pair_places(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes[:-1] * _BASE + hashes[1:]) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_built: dict[str, list[Automaton]] = {}


def _automata(sent, window: int) -> list[Automaton]:
    """The automata of a broadcast, built once for each worker."""
    name, held = sent.value
    if name not in _built:
        _built.clear()
        made = []
        for block in held:
            items = []
            for item, words in block:
                text = " ".join(words).encode()
                found = scanned(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), ALNUM)
                items.append((item, found.hashes.tolist()))
            made.append(Automaton(items, window))
        _built[name] = made
    return _built[name]


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _marked(batches: Iterator[pa.RecordBatch], sent, window: int) -> Iterator[pa.RecordBatch]:
    """Adds the hit spans (in bytes) and items of some blocks to each row's lists."""
    automata = _automata(sent, window)
    for batch in batches:
        names = batch.schema.names
        spans, items, counts = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
        for low, high, words in blocks(batch.column(0), ALNUM):
            counts.append(words.counts())
            for automaton in automata:
                hit, found = automaton.hits(words)
                for d in found:
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    base = int(words.start[a]) if a < b else 0
                    starts, ends = _runs(hit[a:b])
                    spans[low + d] = (spans[low + d] or []) + [{"begin": int(words.start[a + s]) - base, "end": int(words.end[a + e - 1]) - base} for s, e in zip(starts, ends, strict=True)]
                    items[low + d] = sorted({*(items[low + d] or []), *found[d]})
        total = np.concatenate([*counts, np.zeros(0, dtype=np.int64)])
        columns = [batch.column(0), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), pa.array(total, pa.int64()), *batch.columns[4:]]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _marked_and_reported(batches: Iterator[pa.RecordBatch], sent, window: int) -> Iterator[pa.RecordBatch]:
    return _reported(_marked(batches, sent, window))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The spans in order; those of several blocks may meet, only touching bytes join."""
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest columns, and the text without its spans."""
    for batch in batches:
        texts, spans, items = batch.column(0), batch.column(1), batch.column(2)
        rows = len(texts)
        hits, cleaned = np.zeros(rows, dtype=np.int64), [None] * rows
        lists = items.to_pylist()
        for d in [d for d, x in enumerate(lists) if x]:
            raw = texts[d].as_py().encode()
            data = np.frombuffer(raw, dtype=np.uint8)
            words = scanned(data, np.array([0, len(raw)]), ALNUM)
            base, parts, last = int(words.start[0]), [], 0
            for begin, end in _merged(spans[d].as_py()):
                hits[d] += int(np.searchsorted(words.start, base + end)) - int(np.searchsorted(words.start, base + begin))
                parts.append(raw[last : base + begin])
                last = base + end
            parts.append(raw[last:])
            cleaned[d] = b"".join(parts).decode()
        sha = [hashlib.sha256(",".join(sorted(x or [])).encode()).hexdigest() for x in lists]
        counted = pa.array([len(x or []) for x in lists], pa.int64())
        columns = [batch.column(3), pa.array(hits), counted, pa.array(sha), pa.array(cleaned, pa.string()), *batch.columns[4:]]
        yield pa.RecordBatch.from_arrays(columns, names=["n_words", "n_hit", "n_items", "items_sha256", "cleaned", *batch.schema.names[4:]])


def _pieces(words: list[str], window: int) -> Iterator[list[str]]:
    """An item's words; those of a long one in pieces that hold all of its windows."""
    step = MOST_WORDS - window + 1
    for low in range(0, max(1, len(words) - window + 1), step):
        yield words[low : low + MOST_WORDS]


def _item_groups(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[list[list[tuple[str, list[str]]]]]:
    """``TOGETHER`` blocks of items at a time; no more of them come to the driver at once."""
    group, held, words = [], [], 0
    for row in items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).toLocalIterator():
        found = item_words(row.text)
        if row.item is None or not found:
            continue
        for piece in _pieces(found, window):
            held.append((row.item, piece))
            words += len(piece)
            if words >= MOST_WORDS:
                group.append(held)
                held, words = [], 0
                if len(group) == TOGETHER:
                    yield group
                    group = []
    yield [*group, held]


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` with n_words, n_hit, n_items, items_sha256 and cleaned.

    ``cleaned`` is the text without its hit spans, null where nothing is hit.
    ``keep`` names the other columns that are returned (all by default), after
    the five; a name that clashes with one of the five is an error there.
    """
    keep = docs.columns if keep is None else keep
    spark = docs.sparkSession
    kept = [docs[c].alias(f"kept_{k}") for k, c in enumerate(keep)]
    rows = docs.select(docs[text_col].alias("text"), F.lit(None).cast("array<struct<begin:bigint,end:bigint>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words"), *kept)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
    groups = _item_groups(items, item_id_col, item_text_col, window)
    group = next(groups)
    for following in groups:
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, group))
        rows = settled(rows.mapInArrow(partial(tidy, _marked, sent=sent, window=window), schema), "marked")
        sent.destroy()
        group = following
    out = T.StructType().add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("cleaned", "string")
    for field in schema.fields[4:]:
        out = out.add(field)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, group))
    rows = rows.mapInArrow(partial(tidy, _marked_and_reported, sent=sent, window=window), out)
    return rows.select("n_words", "n_hit", "n_items", "items_sha256", "cleaned", *(F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)))


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", most_coverage: float = 0.2, **options) -> DataFrame:
    """``docs`` without hit spans, and without rows whose share of hit words passes ``most_coverage``."""
    columns = docs.columns
    found = contamination(docs.select(*(docs[c].alias(f"in_{k}") for k, c in enumerate(columns))), items, text_col=f"in_{columns.index(text_col)}", **options)
    found = found.where("n_hit <= n_words * " + repr(float(most_coverage)))
    text = F.coalesce("cleaned", f"in_{columns.index(text_col)}")
    values = []
    for k, c in enumerate(columns):
        value = text if c == text_col else F.when(F.col("n_hit") > 0, F.length("cleaned").cast(docs.schema[c].dataType)).otherwise(F.col(f"in_{k}")) if c == "n_chars" else F.col(f"in_{k}")
        values.append(value.alias(c))
    return found.select(*values)
