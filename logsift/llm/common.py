"""Shared pieces of the corpus operators: table access and vectorised word hashing.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8
text with A-Z lower-cased.  They are hashed for a whole chunk of texts at once
with NumPy on the Arrow buffers, so no Python string is made per word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_BYTE = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:8] for i in range(256)), dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (the splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yield (first row, row after the last, bytes, offsets) of chunks of about ``limit`` bytes.

    A null text is an empty one.  A text longer than the limit is a chunk alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, raw[offsets[at]: offsets[end]], offsets[at: end + 1] - offsets[at]
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """Byte starts and ends of the words, and for each text the index of its first word (plus the total)."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a word that runs over the border of two texts is two words
    border = offsets[1:-1]
    border = np.unique(border[(border > 0) & (border < len(data))])
    cut = border[(inside[border] != 0) & (inside[border + 1] != 0)]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_hashes(data: np.ndarray, offsets: np.ndarray, bounds=None, lower: bool = True):
    """64-bit hashes of all words of the texts, and each text's first word index (plus the total)."""
    starts, ends, first = bounds or word_bounds(data, offsets)
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * _power("up", _MULT, n), out=total[1:])
    h = (total[ends] - total[starts]) * _power("down", _INV, n)[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))), first


_SEQ = [_U(int.from_bytes(hashlib.sha256(b"sequence%d" % i).digest()[:8], "little") | 1) for i in range(16)]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words (may be empty)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = words[:m] * _SEQ[0]
    for i in range(1, n):
        total = total + words[i: i + m] * _SEQ[i]
    return mix64(total)


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """One hash of a whole short sequence, unlike that of any run of another length."""
    total = np.array([len(words)], dtype=np.uint64) * _SEQ[15]
    for i in range(len(words)):
        total = mix64(total ^ (words[i: i + 1] * _SEQ[i % 15]))
    return total
