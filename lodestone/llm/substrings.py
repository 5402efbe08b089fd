"""Removal of repeated word windows, prefiltered by a count-min sketch.

1. Documents with equal word sequences are found first; all but the first of a class
   repeat it whole and need no window.
2. Each task counts the windows of its texts in a sparse count-min sketch (two rows,
   counts stop at two); the sketches are merged by segment. Estimates are never too
   low, so no repeated window is lost.
3. A second pass takes the windows whose estimate is two or more. Within a task all
   but the first of a window are settled at once; the firsts of all tasks meet in a
   shuffle by window hash (128 bits), where a window has at most a row for each task.
4. What is to be removed returns to the documents by key.

The sketch has about ``CELLS`` cells for each window in a row, up to ``MAX_CELLS``: this
bounds what tasks hold of it (two bits a cell pair, 128 MB). Beyond about 130 million
windows more windows pass the filter by chance; the result stays exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.storage import persist_table
from lodestone.llm.words import NON_SPACE, Words, as_long, map_texts, mix, slices, split_words, windows

#: Cells for each window and row of the sketch, and cells of a row at most.
CELLS, MAX_CELLS = 4, 1 << 29
#: Cells in a segment.
SEGMENT = 1 << 16
#: Repeated documents up to this number are sent to every task; more are joined by shuffle.
BROADCAST_ROWS = 250_000
#: Stands for a null key, in order.
LAST = (1 << 63) - 1

_U = np.uint64


def _sequence_hashes(words: Words) -> list[np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    out = []
    place = (np.arange(len(words.start)) - np.repeat(words.first[:-1], words.counts)).astype(_U)
    with np.errstate(over="ignore"):
        for lane in (0, 1):
            sums = np.r_[_U(0), np.cumsum(mix(words.hashes(lane) ^ mix(place + _U(1))), dtype=_U)]
            out.append(sums[words.first[1:]] - sums[words.first[:-1]])
    return out


def _sequences(rows: DataFrame) -> DataFrame:
    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(part.column("text"), NON_SPACE)
        h1, h2 = _sequence_hashes(words)
        return pa.RecordBatch.from_arrays([part.column("key"), pa.array(words.counts), pa.array(as_long(h1)), pa.array(as_long(h2))], ["key", "n_words", "h1", "h2"])

    return map_texts(rows.select("key", "text"), kernel, "key long, n_words long, h1 long, h2 long")


def _cells(h: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each hash in both rows of the sketch; the second row lies behind the first."""
    m = _U(cells - 1)
    return [(h & m).astype(np.int64), ((h >> _U(32)) & m).astype(np.int64) + cells]


def _sketch(rows: DataFrame, n: int, cells: int) -> np.ndarray:
    """A bit for each cell that two or more windows of all texts share, or one window twice."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"), NON_SPACE)
                held.append(windows(words.hashes(), words.text, n)[1])
                size += len(held[-1])
                if size > 4_000_000:
                    yield from write(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield from write(np.concatenate(held))

    def write(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in _cells(h, cells):
            row.sort()
            new = np.r_[True, row[1:] != row[:-1]]
            at = np.flatnonzero(new)
            twice = np.diff(np.r_[at, len(row)]) > 1
            row = row[new]
            first = np.flatnonzero(np.r_[True, row[1:] // SEGMENT != row[:-1] // SEGMENT])
            segment = row[first] // SEGMENT
            low = (row % SEGMENT).astype(np.uint16)
            again = low[twice]
            cut = np.r_[first, len(row)]
            cut2 = np.r_[0, np.cumsum(twice)][cut]
            blob = lambda x, c: pa.Array.from_buffers(pa.binary(), len(c) - 1, [None, pa.py_buffer((c * 2).astype(np.int32)), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(segment.astype(np.int32)), blob(low, cut), blob(again, cut2)], ["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count = None, np.zeros(SEGMENT, np.uint8)
        done: list[tuple[int, bytes]] = []
        for batch in batches:
            for segment, once, twice in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if segment != at:
                    if at is not None:
                        done.append((at, np.packbits(count >= 2, bitorder="little").tobytes()))
                    at = segment
                    count[:] = 0
                x = np.frombuffer(once.as_buffer(), np.uint16)
                count[x] = np.minimum(count[x] + 1, 2)
                count[np.frombuffer(twice.as_buffer(), np.uint16)] = 2
        if at is not None:
            done.append((at, np.packbits(count >= 2, bitorder="little").tobytes()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.binary())], ["segment", "bits"])

    parts = rows.select("text").mapInArrow(partial, "segment int, once binary, twice binary")
    merged = persist_table(parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary"), "sub-sketch")
    bits = np.zeros(2 * cells // 8, np.uint8)
    for batch in merged.toArrow().to_batches():  # at most 2 * MAX_CELLS bits
        for segment, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            bits[segment * SEGMENT // 8 : (segment + 1) * SEGMENT // 8] = np.frombuffer(x.as_buffer(), np.uint8)
    return bits


def _not_first(h1: np.ndarray, h2: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of all four: whether a row begins a window, and whether its place isn't the window's first."""
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return new, (key != key[first]) | (start != start[first])


def _runs(key: np.ndarray, tag: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Consecutive starts in one document as (key, tag, from, to)."""
    order = np.lexsort((start, tag, key))
    key, tag, start = key[order], tag[order], start[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + 1)] if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    end = np.r_[at[1:], len(key)] - 1 if len(at) else at
    return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(tag[at]), pa.array(start[at]), pa.array(start[end])], ["key", "tag", "from", "to"])


def _repeats(rows: DataFrame, n: int, cells: int, bits: np.ndarray) -> DataFrame:
    """(key, tag, from, to): runs of starts of windows that also start earlier."""
    sketch = rows.sparkSession.sparkContext.broadcast(bits)

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"), NON_SPACE)
                text = words.text
                start, h = windows(words.hashes(), text, n)
                for row in (0, 1):
                    cell = _cells(h, cells)[row]
                    hit = (sketch.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
                    start, h = start[hit], h[hit]
                if not len(h):
                    continue
                other = windows(words.hashes(1), text, n, 1)
                h2 = other[1][np.searchsorted(other[0], start)]
                owner = text[start]
                key = part.column("key").to_numpy()[owner]
                tag = part.column("tag").to_numpy()[owner]
                held.append((as_long(h), as_long(h2), key, start - words.first[owner], tag))
                size += len(h)
                if size > 6_000_000:
                    yield from settle(held)
                    held, size = [], 0
        if size:
            yield from settle(held)

    def settle(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h1, h2, key, start, tag = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, key, h2, h1))
        h1, h2, key, start, tag = (x[order] for x in (h1, h2, key, start, tag))
        new, repeat = _not_first(h1, h2, key, start)
        done = _runs(key[repeat], tag[repeat], start[repeat])
        none = pa.nulls(done.num_rows, pa.int64())
        names = ["h1", "h2", "key", "tag", "from", "to"]
        yield pa.RecordBatch.from_arrays([none, none, *done.columns], names)
        yield pa.RecordBatch.from_arrays([pa.array(h1[new]), pa.array(h2[new]), pa.array(key[new]), pa.array(tag[new]), pa.array(start[new]), pa.array(start[new])], names)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((4, 0), np.int64)  # the first row of the window that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [np.r_[last[i], batch.column(c).to_numpy()] for i, c in enumerate(("h1", "h2", "key", "from"))]
            tag = np.r_[np.zeros(last.shape[1], np.int64), batch.column("tag").to_numpy()]
            new, repeat = _not_first(*got)
            at = np.flatnonzero(new)[-1]
            last = np.array([[x[at]] for x in got])
            if repeat.any():
                yield _runs(got[2][repeat], tag[repeat], got[3][repeat])

    found = persist_table(rows.select("key", "tag", "text").mapInArrow(flagged, "h1 long, h2 long, key long, tag long, from long, to long"), "sub-windows")
    kind = "key long, tag long, from long, to long"
    met = found.filter("h1 is not null").select("h1", "h2", "key", "tag", "from").repartition("h1").sortWithinPartitions("h1", "h2", "key", "from").mapInArrow(across, kind)
    return found.filter("h1 is null").select("key", "tag", "from", "to").unionByName(met)


def _keep(rows: DataFrame, n: int) -> DataFrame:
    """Drops the words that ``runs`` (pairs of first and last window start) cover."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(part.column("text"), NON_SPACE)
        edge = np.zeros(len(words.start) + 1, np.int64)
        runs = part.column("runs")
        sizes = np.where(runs.is_valid().to_numpy(zero_copy_only=False), np.diff(runs.offsets.to_numpy()), 0)
        flat = runs.flatten()
        base = np.repeat(words.first[:-1], sizes)
        np.add.at(edge, base + flat.field("from").to_numpy(), 1)
        np.add.at(edge, base + flat.field("to").to_numpy() + n, -1)
        keep = np.cumsum(edge[:-1]) == 0
        data = words.data.tobytes()
        removed, text = np.zeros(part.num_rows, np.int64), []
        for i in range(part.num_rows):
            a, b = words.first[i], words.first[i + 1]
            k = keep[a:b]
            removed[i] = (~k).sum()
            s, e = words.start[a:b][k].tolist(), words.end[a:b][k].tolist()
            text.append(b" ".join([data[x:y] for x, y in zip(s, e, strict=True)]))
        return pa.RecordBatch.from_arrays([part.column("key"), pa.array(words.counts), pa.array(removed), pa.array(text, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in text])], ["key", "n_words", "n_removed", "kept", "kept_sha256"])

    return map_texts(rows.select("key", "text", "runs"), kernel, "key long, n_words long, n_removed long, kept string, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, n: int = 20, key: str = "doc_id", text: str = "text", cells: int | None = None) -> DataFrame:
    """Removes each word that a window of ``n`` words covers which also starts earlier.

    Earlier means a smaller key, or the same key and an earlier start; windows are judged
    on the input. Words are runs of anything but ASCII white space, compared unchanged.
    Null and empty texts, and texts of fewer than ``n`` words, lose nothing. Null keys
    come last and count as one document, as do rows that repeat a key; equal rows of one
    key keep the same. An empty table gives none; other columns are not read. ``cells``
    sets the sketch's width (a power of two), otherwise it follows the number of windows.
    Returns key, n_words, n_removed, kept (words joined by one space), kept_sha256.
    """
    order = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    rows = docs.select(order.alias("key"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tag"), F.col(text).alias("text"))
    sequences = persist_table(_sequences(rows), "sub-sequences")
    firsts = persist_table(sequences.filter(F.col("n_words") >= n).groupBy("h1", "h2", "n_words").agg(F.min("key").alias("first")), "sub-classes")
    judged = sequences.filter(F.col("n_words") >= n).join(firsts, ["h1", "h2", "n_words"])
    copies = judged.groupBy("key").agg(F.min((F.col("key") > F.col("first")) & (F.col("key") != LAST)).alias("copy")).filter("copy").select("key")
    copies = persist_table(copies, "sub-copies")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    # Keys whose every row of n words or more repeats an earlier document; their shorter rows have no window.
    left = rows.join(copies, "key", "left_anti")
    if cells is None:
        total = judged.filter(F.col("key") == F.col("first")).agg(F.sum(F.col("n_words") - (n - 1))).first()[0] or 0
        cells = min(MAX_CELLS, max(SEGMENT, 1 << int(CELLS * total).bit_length()))
    repeats = _repeats(left, n, cells, _sketch(left, n, cells))
    runs = persist_table(repeats.groupBy("key", "tag").agg(F.collect_list(F.struct("from", "to")).alias("runs")), "sub-runs")
    kept = _keep(left.join(runs, ["key", "tag"], "left"), n)
    gone = sequences.join(copies, "key", "left_semi")
    whole = gone.filter(F.col("n_words") >= n).select("key", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
    out = kept.unionByName(whole)
    shorter = persist_table(gone.filter(F.col("n_words") < n).select("key").distinct(), "sub-shorter")
    if (n_shorter := shorter.count()) > 0:  # rows of such a key that are too short to have a window
        short = rows.join(F.broadcast(shorter) if n_shorter <= BROADCAST_ROWS else shorter, "key", "left_semi")
        out = out.unionByName(_keep(short.withColumn("runs", F.lit(None).cast("array<struct<from:long,to:long>>")), n).filter(F.col("n_words") < n))
    back = F.when(F.col("key") != LAST, F.col("key")).cast(docs.schema[key].dataType)
    return out.select(back.alias(key), "n_words", "n_removed", "kept", "kept_sha256")
