"""Benchmark decontamination with a positional inverted index of the training texts.

The index is sharded by documents: a segment holds the postings of about half a
megabyte of texts (positions by term, terms being 64-bit hashes of words), and is
written to the shared folder, once and for every term, as one packed value in small row
groups, so that only a worker ever holds postings unpacked, those of one segment at a
time, whatever the size of the table. Searches run segment by segment:
for every benchmark window, the list of its term that is rarest in the segment is taken,
shifted by the term's offset, and intersected with the lists of the other terms, rarest
first. What remains are exact phrase matches. Proximity matches need all terms within a
span.

Benchmark windows go to the tasks in blocks of about ``BLOCK_WINDOWS``, whatever items
they are of. One block is looked up and judged in one pass over the index; of several,
each pass keeps its hits by segment, and a last one adds them up.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.storage import persist_table
from lodestone.llm.words import ALNUM, as_long, lists, map_texts, split_words

#: Benchmark windows in one broadcast, about.
BLOCK_WINDOWS = 200_000
#: Positions that are looked up at once in a segment.
STEP = 1 << 19
#: Parquet's writer looks at sizes only after 100 rows unless told; a hundred segments make a page and
#: a row group that its buffers outside the heap, of each writing and reading thread, follow.
ROW_GROUPS = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def pack(terms: np.ndarray, at: np.ndarray, positions: np.ndarray) -> bytes:
    """Postings as one compressed value: distinct terms, how many positions each has, and positions."""
    flat = np.int64(len(terms)).tobytes() + terms.tobytes() + np.diff(at).astype(np.int32).tobytes() + positions.astype(np.int32).tobytes()
    return np.int64(len(flat)).tobytes() + pa.compress(flat, codec="zstd", asbytes=True)


def unpack(value: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``pack`` was given: terms, where each one's positions begin, and positions."""
    flat = pa.decompress(value[8:], decompressed_size=int(np.frombuffer(value[:8], np.int64)[0]), codec="zstd")
    n = int(np.frombuffer(flat, np.int64, 1)[0])
    counts = np.frombuffer(flat, np.int32, n, 8 + 8 * n)
    return np.frombuffer(flat, np.uint64, n, 8), np.r_[0, np.cumsum(counts, dtype=np.int64)], np.frombuffer(flat, np.int32, -1, 8 + 12 * n)


def index_segments(docs: DataFrame) -> DataFrame:
    """Segments of the index of ``docs`` (key, text): their number and keys, where each text's words
    begin, and the packed postings: distinct terms in order, and the positions of each."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(part.column("text"), ALNUM, lower=True)
        h = words.hashes()
        position = np.argsort(h, kind="stable")
        h = h[position]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        one = lambda x: lists(x, np.array([0, len(x)]))
        keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("key"))
        columns = [pa.array([uuid.uuid4().int >> 65]), keys, one(words.first.astype(np.int32)), pa.array([pack(h[new], np.r_[new, len(h)], position)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["segment", "keys", "first", "postings"])

    kind = docs.schema["key"].dataType.simpleString()
    return map_texts(docs, kernel, f"segment long, keys array<{kind}>, first array<int>, postings binary")


def window_table(items: DataFrame, n: int) -> DataFrame:
    """(item, terms): the distinct windows of ``n`` words of ``items`` (item, text), shorter items whole."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(part.column("text"), ALNUM, lower=True)
        counts = words.counts
        each = np.where(counts > 0, np.maximum(counts - n, 0) + 1, 0)
        owner = np.repeat(np.arange(len(counts)), each)
        start = words.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        length = np.minimum(n, counts[owner])
        offsets = np.r_[0, np.cumsum(length)]
        at = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
        return pa.RecordBatch.from_arrays([part.column("item").take(pa.array(owner)), lists(as_long(words.hashes()[at]), offsets)], ["item", "terms"])

    return map_texts(items, kernel, "item string, terms array<long>").distinct()


@dataclass
class Queries:
    """Windows of benchmark items: their terms, ``width`` each (shorter ones padded), how often a
    window has each (0 for all but the first of equal ones), and items."""

    terms: np.ndarray
    times: np.ndarray
    length: np.ndarray
    item: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, windows: pa.Table, n: int) -> Queries:
        column = windows["terms"].combine_chunks()
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
        length = np.diff(offsets).astype(np.int64)
        used = np.arange(n) < length[:, None]
        terms = np.zeros((len(length), n), np.uint64)
        terms[used] = flat
        same = (terms[:, :, None] == terms[:, None, :]) & used[:, None, :] & used[:, :, None]
        first = ~np.tril(same, -1).any(axis=2)
        names, item = np.unique(np.array(windows["item"].fill_null("").to_pylist(), dtype=object), return_inverse=True) if len(length) else ([], np.zeros(0, np.int64))
        return cls(terms, np.where(first & used, same.sum(axis=2), 0), length, item.astype(np.int64), list(names))

    def matches(self, terms: np.ndarray, at: np.ndarray, positions: np.ndarray, first: np.ndarray, slop: int | None = None, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start position) of the matches in a segment: exact phrases, or with
        ``slop`` all terms, in any order, within the window's length plus ``slop`` words.

        The lists of the windows' rarest terms are laid one after the other and looked up in runs
        of ``step`` positions, so that memory doesn't grow with windows or frequent words. With
        ``slop``, a match may come in more than one run.
        """
        if not len(terms) or not len(self.terms):
            return
        at, positions = at.astype(np.int64), positions.astype(np.int64)
        slot = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        used = np.arange(self.terms.shape[1]) < self.length[:, None]
        often = np.where(terms[slot] == self.terms, np.diff(at)[slot], 0)
        often = np.where(used, often, np.iinfo(np.int64).max)
        alive = np.flatnonzero(often.min(axis=1) > 0)
        if not len(alive):
            return
        rank = np.argsort(often[alive], axis=1, kind="stable")  # rarest term first
        slot, length = slot[alive], self.length[alive]
        until = np.cumsum(often[alive, rank[:, 0]])
        big = np.int64(first[-1] + 1)
        held = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(at)) * big + positions
        # With slop, each position is tried with all the starts that reach it.
        size = max(1, step // (1 if slop is None else int(length.max()) + slop))
        for low in range(0, int(until[-1]), size):
            entry = np.arange(low, min(low + size, int(until[-1])))
            window = np.searchsorted(until, entry, "right")
            within = entry - np.r_[0, until][window]
            start = positions[at[slot[window, rank[window, 0]]] + within]
            yield from self._checked(alive, rank, slot, length, held, big, window, start, first, slop)

    def _checked(self, alive: np.ndarray, rank: np.ndarray, slot: np.ndarray, length: np.ndarray, held: np.ndarray, big: np.int64, window: np.ndarray, start: np.ndarray, first: np.ndarray, slop: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of windows and places of their rarest terms, those where the other terms are too."""
        if slop is None:
            start = start - rank[window, 0]
            span = length[window]
        else:
            span = length[window] + slop
            back = np.repeat(np.arange(len(window)), span)
            ahead = np.arange(len(back)) - np.repeat(np.cumsum(span) - span, span)
            window, start, span = window[back], start[back] - ahead, span[back]
        text = np.searchsorted(first, start, "right") - 1
        fits = (start >= 0) & (start + (span if slop is None else 1) <= first[np.minimum(text + 1, len(first) - 1)])
        window, start, span, text = window[fits], start[fits], span[fits], text[fits]
        for k in range(0 if slop is not None else 1, self.terms.shape[1]):
            live = k < length[window]
            which = rank[window, k]
            want = slot[window, which] * big + start + (which if slop is None else 0)
            place = np.searchsorted(held, want)
            if slop is not None:  # the last of as many as the window has
                times = self.times[alive[window], which]
                live &= times > 0
                place += np.maximum(times - 1, 0)
            got = held[np.minimum(place, len(held) - 1)]
            end = np.minimum(start + span, first[text + 1]) - start
            good = ~live | (got == want if slop is None else (got >= want) & (got < want + end) & (place < len(held)))
            window, start, span, text = window[good], start[good], span[good], text[good]
        if slop is not None:
            window, start = np.unique(np.c_[window, start], axis=0).T
        if len(window):
            yield alive[window], start


def _found(row: pa.RecordBatch, q: Queries, slop: int | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of one segment: which words are hit, and the texts and item names of matches."""
    first = row.column("first").flatten().to_numpy().astype(np.int64)
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    pairs, many = np.zeros(0, np.int64), np.int64(max(len(q.names), 1))
    for window, start in q.matches(*unpack(row.column("postings")[0].as_buffer()), first, slop):
        text = np.searchsorted(first, start, "right") - 1
        edge += np.bincount(start, minlength=len(edge)) - np.bincount(np.minimum(start + q.length[window] + (slop or 0), first[text + 1]), minlength=len(edge))
        pairs = np.union1d(pairs, text * many + q.item[window])
    return np.cumsum(edge[:-1]) > 0, pairs // many, [q.names[i] for i in pairs % many]


def _judged(keys: pa.Array, first: np.ndarray, hit: np.ndarray, text: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """The result's rows of a segment."""
    items: list[set[str]] = [set() for _ in range(len(first) - 1)]
    for t, name in zip(text.tolist(), names, strict=True):
        items[t].add(name)
    listed = [sorted(x) for x in items]
    n_hit = np.diff(np.r_[0, np.cumsum(hit, dtype=np.int64)][first])
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]
    columns = [keys, pa.array(np.diff(first).astype(np.int64)), pa.array(n_hit), pa.array([len(x) for x in listed], pa.int64()), pa.array(listed, pa.list_(pa.string())), pa.array(digest), pa.array(n_hit > 0)]
    return pa.RecordBatch.from_arrays(columns, ["key", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])


def _one_pass(segments: DataFrame, queries: Queries, slop: int | None, schema: str) -> DataFrame:
    """Looks up all windows and judges the documents, segment by segment."""
    asked = segments.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1) for k in range(batch.num_rows)):
                yield _judged(row.column("keys").flatten(), row.column("first").flatten().to_numpy(), *_found(row, asked.value, slop))

    return segments.mapInArrow(run, schema)


def _hits(segments: DataFrame, queries: Queries, slop: int | None) -> DataFrame:
    """(segment, hit bits, texts, names) of the segments where a block of windows matches."""
    asked = segments.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1) for k in range(batch.num_rows)):
                hit, text, names = _found(row, asked.value, slop)
                if len(text):
                    yield pa.RecordBatch.from_arrays([row.column("segment"), pa.array([np.packbits(hit).tobytes()], pa.binary()), pa.array([text.tolist()], pa.list_(pa.int64())), pa.array([names], pa.list_(pa.string()))], ["segment", "hit", "texts", "names"])

    return segments.mapInArrow(run, "segment long, hit binary, texts array<long>, names array<string>")


def _added_up(segments: DataFrame, hits: DataFrame, schema: str) -> DataFrame:
    """Judges the documents by the hits of all blocks; of the index only the texts' places are read."""
    by = hits.groupBy("segment").agg(F.collect_list("hit").alias("hits"), F.flatten(F.collect_list("texts")).alias("texts"), F.flatten(F.collect_list("names")).alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1) for k in range(batch.num_rows)):
                first = row.column("first").flatten().to_numpy()
                bits = np.zeros(-(-int(first[-1]) // 8), np.uint8)
                for x in row.column("hits")[0].as_py() or ():
                    bits |= np.frombuffer(x, np.uint8)
                text = np.array(row.column("texts")[0].as_py() or (), np.int64)
                yield _judged(row.column("keys").flatten(), first, np.unpackbits(bits)[: first[-1]], text, row.column("names")[0].as_py() or [])

    return segments.select("segment", "keys", "first").join(by, "segment", "left").mapInArrow(run, schema)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, slop: int | None = None, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Words of each document that windows of ``n`` benchmark words cover.

    Words are runs of ASCII letters (in lower case), digits and non-ASCII characters. An
    item of fewer words is one window; null and empty ones have none. With ``slop``, a
    window also matches wherever its length plus ``slop`` consecutive words of a document
    (fewer at its end) hold all its words, each as often, in any order; all words of such
    a span are hit. Null and empty documents have no words; null keys, keys of any type,
    repeated rows and long texts each give their row, judged whole; a null item id counts
    as the empty string; items that repeat an id count once. Empty tables give no rows, or
    no hits. Other columns are not read. Returns key, n_words, n_hit, n_items, items,
    items_sha256 (ids sorted as strings, comma-joined), contaminated.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    asked = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter(F.length("text") > 0)
    windows = persist_table(window_table(asked, n), "windows")
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    schema = f"key {docs.schema[key].dataType.simpleString()}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"
    segments = persist_table(index_segments(rows), "index", ROW_GROUPS)
    if blocks == 1:
        out = _one_pass(segments, Queries.of(windows.toArrow(), n), slop, schema)
    else:
        hits = None
        for b in range(blocks):
            block = windows.filter(F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)) == b).toArrow()
            found = persist_table(_hits(segments, Queries.of(block, n), slop), "index-hits")
            hits = found if hits is None else hits.unionByName(found)
        out = _added_up(segments, hits, schema)
    return out.withColumnRenamed("key", key)
