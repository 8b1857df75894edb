"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's inputs are its word counts in ``BUCKETS`` hash buckets (scaled to unit
length), statistics of its structure, and its recorded length.  Pairs of inputs
interact through ``RANK`` factors, and all pairs are summed in linear time:

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

The model is fitted on at most ``MOST_LABELLED`` labelled rows, those of smallest
hashed id, and sent to the tasks, which score every row.  Labels, language,
source and id are no inputs.

Null and empty texts have zero counts and get a score like any other.  Labelled
rows of null id or label, and ids whose labels contradict each other, are left
out of the fit; without labels of both kinds the score is the smoothed share of
label 1.  Rows are scored one by one, so repeated rows and null ids change
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy
from .wordhash import ALNUM, Words, blocks

BUCKETS = 4096
RANK = 8
MOST_LABELLED = 4000
EPOCHS = 12
BATCH = 128
RATE = 0.02
DECAY = 1e-4
SEED = 7

#: Structure: words, mean word length, distinct words, repeats, distinct pairs,
#: capitals, symbols, digits, line breaks, marks of each kind; then the recorded length.
STATISTICS = 16


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def _byte_class(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars.encode())] = True
    return table


_CAPITALS = _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SMALL = _byte_class("abcdefghijklmnopqrstuvwxyz")
_DIGITS = _byte_class("0123456789")
_PAUSES = _byte_class(".,;:?")
_SYMBOLS = _byte_class("!\"#$%&'()*+-/<=>@[\\]^_`{|}~")
_PIPES = _byte_class("|")
_BANGS = _byte_class("!")
_BREAKS = _byte_class("\n")
_BLANKS = _byte_class(" \t\n\r")


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[edges[1:]] - sums[edges[:-1]]).astype(np.float64)


def _entries(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the non-zero word inputs, and distinct words of each text."""
    texts = len(words.first) - 1
    owner = np.repeat(np.arange(texts), words.counts())
    keys, counts = np.unique(owner * BUCKETS + (words.hashes >> np.uint64(52)).astype(np.int64), return_counts=True)
    of, bucket, value = keys // BUCKETS, keys % BUCKETS, np.sqrt(counts)
    norm = np.sqrt(np.bincount(of, value**2, texts))
    return of, bucket, value / norm[of], np.bincount(of, minlength=texts)


def _statistics(raw: np.ndarray, edges: np.ndarray, words: Words, recorded: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    count = words.counts().astype(np.float64)
    some, size = np.maximum(count, 1), np.maximum(np.diff(edges), 1).astype(np.float64)
    repeated = np.zeros(len(words.hashes), dtype=bool)
    repeated[1:] = words.hashes[1:] == words.hashes[:-1]
    again = np.zeros(len(words.hashes), dtype=bool)
    if len(again) > 2:
        again[2:] = words.hashes[2:] == words.hashes[:-2]
    capital, small = _per_text(_CAPITALS[raw], edges), _per_text(_SMALL[raw], edges)
    symbols = _per_text(_SYMBOLS[raw], edges)
    return np.stack(
        [
            np.log1p(count),
            _per_text(words.end - words.start, words.first) / some,
            buckets / np.minimum(some, BUCKETS),
            np.log1p(buckets) / np.log1p(some),
            _per_text(repeated, words.first) / some,
            _per_text(again, words.first) / some,
            capital / np.maximum(capital + small, 1),
            symbols / size,
            symbols / some,
            _per_text(_DIGITS[raw], edges) / size,
            _per_text(_PAUSES[raw], edges) / some,
            _per_text(_PIPES[raw], edges) / some,
            _per_text(_BANGS[raw], edges) / some,
            _per_text(_BREAKS[raw], edges) / some,
            _per_text(_BLANKS[raw], edges) / size,
            np.log1p(np.maximum(recorded, 0)),
        ],
        axis=1,
    )


def _inputs(batch: pa.RecordBatch, text: int, recorded: int):
    """(low, high, text, bucket, value, statistics) of each block of a batch."""
    lengths = batch.column(recorded).to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.nan_to_num(lengths)
    for low, high, words in blocks(batch.column(text), ALNUM):
        of, bucket, value, distinct = _entries(words)
        raw, edges = words.raw, words.edges
        yield low, high, of, bucket, value, _statistics(raw, edges, words, lengths[low:high], distinct)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, label, buckets, values, statistics) of labelled rows."""
    for batch in batches:
        for low, high, of, bucket, value, statistics in _inputs(batch, 2, 3):
            edges = pa.array(np.searchsorted(of, np.arange(high - low + 1)), pa.int32())
            rows = pa.array(np.arange(high - low + 1) * STATISTICS, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(low, high - low),
                    batch.column(1).slice(low, high - low),
                    pa.ListArray.from_arrays(edges, pa.array(bucket, pa.int32())),
                    pa.ListArray.from_arrays(edges, pa.array(value)),
                    pa.ListArray.from_arrays(rows, pa.array(statistics.ravel())),
                ],
                names=["id", "label", "buckets", "vals", "statistics"],
            )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _outputs(model: Model, texts: int, of, bucket, value, statistics) -> np.ndarray:
    """Probabilities, by the sum-of-squares identity over the non-zero inputs."""
    dense = np.clip((statistics - model.mean) / model.spread, -4, 4)
    w, v = model.weights, model.factors
    linear = model.bias + np.bincount(of, w[bucket] * value, texts) + dense @ w[BUCKETS:]
    crossed = np.zeros(texts)
    for f in range(RANK):
        own = v[bucket, f] * value
        sums = np.bincount(of, own, texts) + dense @ v[BUCKETS:, f]
        squares = np.bincount(of, own * own, texts) + (dense * dense) @ (v[BUCKETS:, f] ** 2)
        crossed += sums * sums - squares
    return _sigmoid(linear + crossed / 2)


def fitted(labels: np.ndarray, buckets: list, values: list, statistics: np.ndarray) -> Model:
    """Adam over small dense batches; the order of rows is fixed by the caller."""
    count, size = len(labels), BUCKETS + STATISTICS
    rng = np.random.default_rng(SEED)
    share = (labels.sum() + 1) / (count + 2)
    model = Model(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.01, (size, RANK)), np.zeros(STATISTICS), np.ones(STATISTICS))
    if count == 0 or labels.min() == labels.max():
        model.factors[:] = 0
        return model
    model.mean, model.spread = statistics.mean(0), statistics.std(0) + 1e-6
    dense = np.clip((statistics - model.mean) / model.spread, -4, 4)
    parameters = [np.array([model.bias]), model.weights, model.factors]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    steps = 0
    for _ in range(EPOCHS):
        order = rng.permutation(count)
        for low in range(0, count, BATCH):
            rows = order[low : low + BATCH]
            x = np.zeros((len(rows), size))
            for k, r in enumerate(rows.tolist()):
                x[k, buckets[r]] = values[r]
            x[:, BUCKETS:] = dense[rows]
            sums, squared = x @ parameters[2], x * x
            out = parameters[0] + x @ parameters[1] + (sums**2 - squared @ parameters[2] ** 2).sum(1) / 2
            g = (_sigmoid(out) - labels[rows]) / len(rows)
            gradients = [np.array([g.sum()]), x.T @ g + DECAY * parameters[1], x.T @ (g[:, None] * sums) - parameters[2] * (squared.T @ g)[:, None] + DECAY * parameters[2]]
            steps += 1
            for p, d, m, s in zip(parameters, gradients, first, second, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                p -= RATE * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8)
    model.bias = float(parameters[0][0])
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", label_col: str = "quality", train=None) -> Model:
    """A model from at most MOST_LABELLED rows of ``labels``; ``train`` is a condition on "id"."""
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label is not null")
    if train is not None:
        known = known.where(train)
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").drop("high")
    # at most MOST_LABELLED rows of two numbers, so they may be broadcast
    known = known.orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), docs[length_col].cast("double").alias("recorded"))
    rows = rows.join(F.broadcast(known), "id").select("id", "label", "text", "recorded")
    # several rows may share a labelled id: the same bound holds for rows
    table = rows.mapInArrow(partial(tidy, _featured), "id long, label int, buckets array<int>, vals array<double>, statistics array<double>").orderBy(F.xxhash64("id"), "id", F.hash("buckets", "vals")).limit(MOST_LABELLED).toArrow()
    statistics = np.array(table["statistics"].to_pylist()).reshape(-1, STATISTICS)
    return fitted(table["label"].to_numpy().astype(np.float64), table["buckets"].to_pylist(), table["vals"].to_pylist(), statistics)


def _scored(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        scores = np.zeros(batch.num_rows)
        for low, high, *inputs in _inputs(batch, 0, 1):
            scores[low:high] = _outputs(model, high - low, *inputs)
        yield pa.RecordBatch.from_arrays([pa.array(scores), *batch.columns[2:]], names=["score", *batch.schema.names[2:]])


def scored(docs: DataFrame, model: Model, text_col: str = "text", length_col: str = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """Each row's ``score`` (0 to 1), then its columns ``keep`` (all by default)."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(docs[text_col].alias("text"), docs[length_col].cast("double").alias("recorded"), *(docs[c].alias(f"kept_{k}") for k, c in enumerate(keep)))
    schema = "score double" + "".join(f", kept_{k} {rows.schema[f'kept_{k}'].dataType.simpleString()}" for k in range(len(keep)))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(tidy, _scored, sent=sent), schema).select("score", *(F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)))
