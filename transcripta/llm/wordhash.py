"""Vectorised word scanning of Arrow text columns.

Every operator on words reads UTF-8 bytes, never Python strings: a byte table
says which bytes belong to a word, and words are mixed into 64-bit hashes eight
bytes at a time, all words of a block at once.  A block of texts is bounded in
bytes, so a task's memory doesn't depend on how many rows Arrow hands over; only a
single text larger than the block makes a larger one.

Nulls count as empty texts.  Two different words share a hash with a chance of
about 2**-64, which the operators accept as equality; every step mixes all bits, so
no family of words is known to collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

#: Words of more bytes are hashed one by one.
LONG_WORD = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The low 0 to 8 bytes of an integer.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _without(*ranges: tuple[int, int]) -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    for low, high in ranges:
        inside[low : high + 1] = False
    return inside


LOWER = _lowered()
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
ALNUM = _without((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Words ``[^\x20\x09-\x0D]+``.
SPACED = _without((0x20, 0x20), (0x09, 0x0D))


@dataclass
class Words:
    """The words of a block: ``first[d]:first[d + 1]`` are those of text ``d``.

    ``raw[edges[d]:edges[d + 1]]`` are its bytes as they were.
    """

    raw: np.ndarray
    edges: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word ``data[start:end]``, eight bytes at a time; long words by BLAKE2."""
    length = end - start
    hashes = mixed(length.astype(np.uint64) * _BASE)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = np.where(length > LONG_WORD, 0, length)
    active, passed = np.flatnonzero(left), 0
    while len(active):
        rest = left[active]
        chunk = eights[start[active] + passed]
        chunk &= _MASKS[np.minimum(rest, 8)]
        # bijective in the chunk: words of up to eight bytes and one length never collide
        hashes[active] = mixed((hashes[active] ^ chunk) * _BASE)
        left[active] = rest - 8
        active = active[rest > 8]
        passed += 8
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return hashes


def scanned(values: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Words of the texts ``values[offsets[d]:offsets[d + 1]]``."""
    data = LOWER[values]
    size, docs = len(data), len(offsets) - 1
    if not size:
        none = np.zeros(0, dtype=np.int64)
        return Words(values, offsets, np.zeros(docs + 1, dtype=np.int64), none, none, none.astype(np.uint64))
    word = inside[values]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = offsets[(offsets > 0) & (offsets < size)]
    begins[edges] = word[edges]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[edges - 1] = word[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(values, offsets, np.searchsorted(start, offsets), start, end, _hashed(data, start, end))


def blocks(texts: pa.Array, inside: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, words) over consecutive rows of about ``most`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    filled = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    rows = len(filled)
    _, offset_buffer, data_buffer = filled.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[filled.offset : filled.offset + rows + 1] if rows else np.zeros(1, dtype=np.int64)
    values = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        part = offsets[low : high + 1]
        yield low, high, scanned(values[part[0] : part[-1]], part - part[0], inside)
        low = high


def shingles(words: Words, size: int, keep_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of ``size`` words; a shorter text with words is one run if ``keep_short``."""
    count, total = words.counts(), len(words.hashes)
    owner = np.repeat(np.arange(len(count)), count)
    runs = max(0, total - size + 1)
    joined = np.zeros(runs, dtype=np.uint64)
    for j in range(size):
        joined = joined * _BASE + words.hashes[j : j + runs]
    whole = owner[:runs] == owner[size - 1 : size - 1 + runs]
    hashes, owners = mixed(joined[whole]), owner[:runs][whole]
    short = np.flatnonzero((count > 0) & (count < size)) if keep_short else np.zeros(0, dtype=np.int64)
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for k, d in enumerate(short):
            value = np.uint64(count[d])
            with np.errstate(over="ignore"):
                for h in words.hashes[words.first[d] : words.first[d + 1]]:
                    value = value * _INVERSE + h
            extra[k] = value
        hashes, owners = np.concatenate([hashes, mixed(extra)]), np.concatenate([owners, short])
    return hashes, owners


def distinct(hashes: np.ndarray, owners: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted: (hashes, first position of each text)."""
    if np.any(owners[1:] < owners[:-1]):
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    first = np.searchsorted(owners, np.arange(texts + 1))
    parts = [np.unique(hashes[first[d] : first[d + 1]]) for d in range(texts)]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=texts)
    return np.concatenate([*parts, np.zeros(0, dtype=np.uint64)]), np.concatenate([[0], np.cumsum(sizes)])
