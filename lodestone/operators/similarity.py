"""Exact vector search for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lexical import ranked

#: Query vectors compared in one pass over the stored ones.
QUERY_BLOCK = 1000
#: Scores of (stored, asked) pairs that a task holds at once.
PAIRS = 1 << 19


def _codes(column: pa.Array, size: int) -> np.ndarray:
    """Rows of ``size`` bytes; null and codes of another length become zeros."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if column.null_count or (np.diff(offsets) != size).any():
        return np.array([np.frombuffer(x, np.uint8) if x is not None and len(x) == size else np.zeros(size, np.uint8) for x in column.to_pylist()], np.uint8).reshape(-1, size)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, size)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` doubles; null and vectors of another length become zeros. Bytes are eight-bit numbers, or an eighth as many bits."""
    if pa.types.is_binary(column.type):
        sizes = pc.binary_length(column).drop_null().unique().to_pylist()
        if dim in sizes or -(-dim // 8) not in sizes:
            return _codes(column, dim).view(np.int8) / 127.0
        bits = np.unpackbits(_codes(column, -(-dim // 8)), axis=1)[:, :dim]
        return 2.0 * bits - 1
    rows = [np.asarray(x, float) if x is not None and len(x) == dim and None not in x else np.zeros(dim) for x in column.to_pylist()] if column.null_count or (np.diff(column.offsets.to_numpy()) != dim).any() or column.flatten().null_count else None
    return np.array(rows).reshape(-1, dim) if rows is not None else column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None]


def packed(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """``rows`` with a column of vectors made binary: a byte for each component (int8), or a bit (bit).

    That is a quarter of what floats take, or a thirty-second. Null vectors stay null, null components count as 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for v in batch.column(column).to_pylist():
                x = None if v is None else np.array([0.0 if c is None else c for c in v])
                made.append(None if x is None else (np.packbits(x > 0) if kind == "bit" else np.clip(np.rint(x * 127), -128, 127).astype(np.int8)).tobytes())
            at = batch.schema.get_field_index(column)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    kinds = ", ".join(f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, kinds)


def quantised(x: np.ndarray) -> np.ndarray:
    """What remains of vectors stored as eight-bit numbers."""
    return np.clip(np.rint(x * 127), -128, 127) / 127


def _differing(codes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How many bits of packed codes and asked ones (0 or 1) differ, by counts of the bits of their exclusive or."""
    want = np.packbits(asked.astype(np.uint8), axis=1)
    out = np.empty((len(codes), len(want)), np.int64)
    for k, w in enumerate(want):
        out[:, k] = np.bitwise_count(codes ^ w).sum(axis=1, dtype=np.int64)
    return out


def _scores(stored: np.ndarray, asked: np.ndarray, kind: str) -> np.ndarray:
    """Scores of (stored, asked) pairs; ``asked`` is of unit length, or bits; ``stored`` may be packed bits if it is."""
    if kind == "hamming" and stored.dtype == np.uint8:
        return 1 / (1 + _differing(stored, asked))
    if kind == "hamming":
        bits = (stored > 0).astype(float)
        return 1 / (1 + bits.sum(axis=1)[:, None] + asked.sum(axis=1) - 2 * bits @ asked.T)
    return _unit(quantised(stored) if kind == "int8" else stored) @ asked.T


def slices(batches: Iterator[pa.RecordBatch], width: int, pairs: int = PAIRS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, so many at a time that ``width`` numbers of each are ``pairs`` at most."""
    size = max(1, pairs // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


class _Best:
    """What can be among the first ``room`` of each query, of all that a task has seen.

    Scores within 1e-8 of the last place stay, since ranks round them; of equal ones those of
    the smallest whole-number ids.
    """

    def __init__(self, room: np.ndarray) -> None:
        self.room, self.floor = room, np.full(len(room), -np.inf)
        self.query, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, score: np.ndarray, ids: pa.Array) -> None:
        """Takes the scores (stored, asked) of some stored vectors."""
        place = len(score) - self.room
        some = np.flatnonzero(place > 0)
        cut = self.floor.copy()
        if len(some):
            cut[some] = np.maximum(cut[some], np.partition(score, np.unique(place[some]), axis=0)[place[some], some] - 1e-8)
        row, query = np.nonzero(score >= cut)
        if not len(row):
            return
        more = ids.take(pa.array(row))
        self.query, self.score = np.r_[self.query, query], np.r_[self.score, score[row, query]]
        self.ids = more if self.ids is None else pa.concat_arrays([self.ids, more])
        self._cut()

    def _cut(self) -> None:
        whole = pa.types.is_integer(self.ids.type) and not self.ids.null_count
        order = np.lexsort((self.ids.to_numpy() if whole else np.arange(len(self.ids)), -self.score, self.query))
        query, score = self.query[order], self.score[order]
        at = np.arange(len(order))
        new = np.r_[True, query[1:] != query[:-1]]
        heads = np.flatnonzero(new)
        start = lambda gap: np.maximum.accumulate(np.where(np.r_[True, new[1:] | (score[:-1] - score[1:] > gap)], at, 0))
        same, near = start(0), start(1e-8)  # where equal scores begin, and such that rounding may mix
        sizes, room = np.diff(np.r_[heads, len(order)]), self.room[query[heads]]
        full = sizes >= room
        self.floor[query[heads[full]]] = score[heads[full] + room[full] - 1] - 1e-8
        keep = score >= self.floor[query]
        if whole:
            keep &= near - start(np.inf) + at - same < self.room[query]
        self.query, self.score, self.ids = query[keep], score[keep], self.ids.take(pa.array(order[keep]))


def vector_scan(vectors: DataFrame, queries: DataFrame, *, limit: int = 50, kind: str = "cosine", excluded: DataFrame | None = None) -> DataFrame:
    """Best chunks for queries (query_id, query) over vectors (chunk_id, embedding), with vec_rank.

    ``kind`` is cosine, int8 (cosine with stored vectors rounded to eight bits) or hamming (1 /
    (1 + differing bits)). The query set goes out in blocks of ``QUERY_BLOCK``; each rides along
    with a scan of all vectors, and of every task only what can be among the first leaves it. A
    zero or null vector, or one of another length than the query, scores 0. ``excluded``
    (query_id, chunk_id) are left out before the ranking. Filter the vectors first: nothing is
    cut before the ranking. Vectors may be packed codes (binary: a byte for each component, or
    a bit, for hamming the latter).
    """
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    asked = queries.select("query_id", "query", F.lit(limit).cast("long").alias("room"))
    if excluded is not None:  # each query keeps as many more as are left out of it
        gone = excluded.groupBy("query_id").agg(F.count("*").alias("gone"))
        asked = asked.join(gone, "query_id", "left").select("query_id", "query", (F.col("room") + F.coalesce("gone", F.lit(0))).alias("room"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    kinds = [queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()]
    out = None
    for b in range(blocks):
        one = asked.filter(F.col("block") == b).toArrow()
        block = queries.sparkSession.sparkContext.broadcast(one.combine_chunks())

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            table = block.value
            if not table.num_rows:
                return
            ids, column = table["query_id"].combine_chunks(), table["query"].combine_chunks()
            dim = max(map(len, filter(None, column.to_pylist())), default=0)
            want, room = _matrix(column, dim), table["room"].to_numpy()
            want = (want > 0).astype(float) if kind == "hamming" else _unit(want)
            best = _Best(room)
            for batch in slices(batches, len(room)):
                own = batch.column("embedding")
                packed = kind == "hamming" and pa.types.is_binary(own.type)
                best.add(_scores(_codes(own, -(-dim // 8)) if packed else _matrix(own, dim), want, kind), batch.column("chunk_id"))
            if best.ids is not None:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.query)), best.ids, pa.array(best.score)], ["query_id", "chunk_id", "score"])

        found = vectors.select("chunk_id", "embedding").mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
        out = found if out is None else out.unionByName(found)
    if excluded is not None:
        out = out.join(excluded.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return ranked(out, limit, "vec_rank")


def cosine_scan(vectors: DataFrame, queries: DataFrame, *, limit: int = 50) -> DataFrame:
    """``vector_scan`` by cosine."""
    return vector_scan(vectors, queries, limit=limit)
