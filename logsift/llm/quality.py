"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader (operator 7).

Features of a text, hashed into 2**18 columns: its words and pairs of words,
and runs of one to three word shapes (first and last character's kind, length,
whether the word repeats the one before, whether a line ends).  Each family's
counts are divided by their sum, so a text's length doesn't scale its score.

Training (FTRL-Proximal with per-coordinate rates and L1) sees at most
``max_rows`` labelled rows, those with the smallest hash of their doc_id; each epoch
streams the written sparse vectors through one task, which holds the state and a batch
of them, however long the texts are, and yields at most 2**18 weights, which is all that reaches the driver and is sent to the executors.
Scoring is one pass of sparse dot products over all documents.

Defined results: a null, empty or blank text scores the intercept alone; rows
whose label or doc_id is null aren't learned from; without labelled rows every
score is 0.5; repeated rows score alike; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship_package
from .common import mix64, ngram_hashes, text_chunks, word_bounds, word_hashes

BITS = 18
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.0, 3
MAX_ROWS = 16_384
THRESHOLD = 0.3
_SCALE = 8.0

_KIND = np.full(256, 5, dtype=np.uint64)       # punctuation and control
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A small code of each word's look."""
    length = ends - starts
    last = data[ends - 1]
    size = np.minimum(np.ceil(np.log2(np.maximum(length, 1) + 1)), 6).astype(np.uint64)
    same = np.zeros(len(words), dtype=np.uint64)
    same[1:] = words[1:] == words[:-1]
    after = np.where(ends < len(data), data[np.minimum(ends, len(data) - 1)], 10)
    code = _KIND[data[starts]] | (_KIND[last] << np.uint64(3)) | (size << np.uint64(6)) | (same << np.uint64(9))
    code |= (after == 10).astype(np.uint64) << np.uint64(10)
    # which mark ends the word, if one does
    return mix64(code | (np.where(_KIND[last] == 5, last, 0).astype(np.uint64) << np.uint64(11)))


def features(data: np.ndarray, offsets: np.ndarray):
    """Per text: sorted column indices and values."""
    bounds = word_bounds(data, offsets)
    starts, ends, first = bounds
    words, _ = word_hashes(data, offsets, bounds)
    looks = shapes(data, starts, ends, words) if len(words) else words
    low = np.uint64((1 << BITS) - 1)
    for a, b in zip(first[:-1], first[1:]):
        families = [words[a:b], ngram_hashes(words[a:b], 2)]
        families += [ngram_hashes(looks[a:b], n) ^ np.uint64(0x5851F42D4C957F2D) for n in (1, 2, 3)]
        index, value = [], []
        for f in families:
            if len(f):
                index.append((mix64(f) & low).astype(np.int32))
                value.append(np.full(len(f), _SCALE / len(f)))
        if not index:
            yield np.zeros(0, np.int32), np.zeros(0)
            continue
        index = np.concatenate(index)
        columns, inverse = np.unique(index, return_inverse=True)
        yield columns, np.bincount(inverse, weights=np.concatenate(value), minlength=len(columns))


def _vectors(batches):
    """(order, label, text) to (order, label, columns, values)."""
    for batch in batches:
        for at, end, data, offsets in text_chunks(batch.column(2)):
            rows = list(features(data, offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at),
                 pa.array([c.tobytes() for c, _ in rows], pa.binary()),
                 pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())], names=["o", "label", "c", "v"])


class Ftrl:
    """Sums of adjusted gradients and of their squares, the state that the weights follow from."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros((1 << BITS) + 1) if z is None else z
        self.n = np.zeros((1 << BITS) + 1) if n is None else n

    def weight(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, columns: np.ndarray, values: np.ndarray, label: float) -> None:
        i, x = np.append(columns, 1 << BITS), np.append(values.astype(np.float64), 1.0)
        w = self.weight(i)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def _epoch(state):
    """Learns from rows (o, label, c, v) as they come and yields the state."""
    def run(batches):
        z, n = state.value
        model = Ftrl(z.copy(), n.copy())
        for batch in batches:
            for y, c, v in zip(batch.column(1).to_numpy(), batch.column(2), batch.column(3)):
                model.learn(np.frombuffer(c.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32), y)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.z, model.n)], names=["z", "n"])
    return run


def ftrl(rows, epochs: int = EPOCHS) -> np.ndarray:
    """Weights and intercept from (columns, values, label) rows, in the given order."""
    model = Ftrl()
    for _ in range(epochs):
        for row in rows:
            model.learn(*row)
    return model.weight(np.arange((1 << BITS) + 1))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights (2**18, then the intercept) learned from the labelled rows where ``learn`` (of ``id_col``) holds."""
    ship_package(docs.sparkSession)
    wanted = (labels.select(F.col(id_col), F.col(label_col).cast("double").alias("label")).where(learn)
              .where(F.col(id_col).isNotNull() & F.col("label").isNotNull()).dropDuplicates([id_col])
              .orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
              .select(id_col, "label"))
    wanted = materialize(wanted, "labelled")
    # at most max_rows short rows are sent out, so the texts of other documents never move
    rows = (docs.select(id_col, F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(wanted), id_col).dropDuplicates([id_col])
            .select(F.xxhash64(id_col).alias("o"), "label", "text")
            .mapInArrow(_vectors, "o long, label double, c binary, v binary"))
    # an epoch streams the written vectors through one task, in order; the task holds the state and a batch of them
    vectors = materialize(rows, "vectors").coalesce(1).sortWithinPartitions("o")
    model = Ftrl()
    for _ in range(EPOCHS):
        state = docs.sparkSession.sparkContext.broadcast((model.z, model.n))
        for r in vectors.mapInArrow(_epoch(state), "z binary, n binary").collect():     # one row of a fixed size
            model = Ftrl(*(np.frombuffer(r[c], np.float64) for c in ("z", "n")))
    return model.weight(np.arange((1 << BITS) + 1))


def _score(texts, weights: np.ndarray):
    """(first row, row after the last, scores) of chunks of a column of texts."""
    for at, end, data, offsets in text_chunks(texts):
        yield at, end, [1.0 / (1.0 + np.exp(-np.clip(weights[c] @ v + weights[-1], -35, 35))) for c, v in features(data, offsets)]


def scores(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row."""
    ship_package(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches):
        w = model.value
        for batch in batches:
            for at, end, s in _score(batch.column(1), w):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(s, pa.float64())],
                                                 names=[id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def scored_rows(df: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """(row, score): every row of ``df`` as a struct with its score, without a join."""
    ship_package(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    place = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            for at, end, s in _score(row.field(place), model.value):
                yield pa.RecordBatch.from_arrays([row.slice(at, end - at), pa.array(s, pa.float64())], names=["row", "score"])

    schema = T.StructType([T.StructField("row", df.schema), T.StructField("score", T.DoubleType())])
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
