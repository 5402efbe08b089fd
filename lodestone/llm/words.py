"""Vectorised word splitting and hashing over Arrow string columns.

A batch of texts is one byte buffer; words are runs of bytes that a 256-entry
table accepts, and hashes are polynomial prefix sums modulo 2**64, so that no
Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Text bytes that one numpy step works on.
STEP_BYTES = 1 << 19

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of anything but ASCII white space.
NON_SPACE = ~_SPACES
#: Words are runs of ASCII letters, digits and bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: ASCII lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection that scatters close values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BASES = [_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)]
_INVERSES = [_U(pow(int(b), -1, 1 << 64)) for b in _BASES]
_POWERS: list[list[np.ndarray]] = [[np.ones(1, _U)] * 2, [np.ones(1, _U)] * 2]


def _powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a hash base and of its inverse modulo 2**64."""
    up, down = _POWERS[lane]
    if len(up) <= n:
        size = 1 << int(n + 1).bit_length()
        with np.errstate(over="ignore"):
            up = np.cumprod(np.r_[_U(1), np.full(size, _BASES[lane], _U)], dtype=_U)
            down = np.cumprod(np.r_[_U(1), np.full(size, _INVERSES[lane], _U)], dtype=_U)
        if size <= 4 * STEP_BYTES:
            _POWERS[lane] = [up, down]
    return up, down


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(ends) or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _translated(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table.tobytes()), np.uint8)


@dataclass
class Words:
    """Words of a batch of texts: byte ranges in ``data``; text i has ``first[i]:first[i+1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text's number, for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; ``lane`` 0 or 1 choose independent functions."""
        up, down = _powers(len(self.data), lane)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, _U)
            np.multiply(self.data, up[: len(self.data)], out=sums[1:], dtype=_U)
            np.cumsum(sums, out=sums)
            return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(_U))


def split_words(column: pa.Array, accepts: np.ndarray = NON_SPACE, lower: bool = False) -> Words:
    data, offsets = texts_of(column)
    if lower:
        data = _translated(data, LOWER)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    inside = _translated(data, accepts).view(bool)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, text: np.ndarray, n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each run of ``n`` consecutive words inside one text."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    base = _BASES[lane]
    out, have, run, width = np.zeros(len(hashes) - n + 1, _U), 0, hashes, 1
    with np.errstate(over="ignore"):
        while True:  # binary expansion of n: run[i] is the hash of width words from i
            if n & width:
                out = out * _U(pow(int(base), width, 1 << 64)) + run[have : have + len(out)]
                have += width
            if have == n:
                break
            run = run[:-width] * _U(pow(int(base), width, 1 << 64)) + run[width:]
            width *= 2
    start = np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1])
    return start, mix(out[start] + _U(n))


def shingles(words: Words, n: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct runs of ``n`` words, sorted by both.

    A text of one to ``n - 1`` words gives its whole sequence as one shingle; a
    text without words gives none.
    """
    hashes, text = words.hashes(lane), words.text
    start, value = windows(hashes, text, n, lane)
    owner = text[start]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        whole = np.empty(len(short), _U)
        for k, i in enumerate(short):
            h = _U(0)
            with np.errstate(over="ignore"):
                for x in hashes[words.first[i] : words.first[i + 1]]:
                    h = h * _BASES[lane] + x
                whole[k] = h + _U(words.counts[i])
        owner, value = np.r_[owner, short], np.r_[value, mix(whole)]
    if len(short):
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    cut = np.searchsorted(owner, np.arange(len(words.first)))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        value[a:b].sort()
    if len(value):
        new = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]
        owner, value = owner[new], value[new]
    return owner, value


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``limit`` text bytes; a longer text goes alone, whole."""
    if not batch.num_rows:
        return
    _, offsets = texts_of(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = STEP_BYTES) -> DataFrame:
    """Applies ``kernel`` to slices of ``df``, which has a column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", limit):
                out = kernel(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def as_long(x: np.ndarray) -> np.ndarray:
    """Bits of unsigned values as Spark's signed long."""
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: pa.Array | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and n+1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
