"""Numpy kernels over bounded groups of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, key: str, kernel: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies ``kernel`` to the rows of each value of the long column ``key``.

    Rows are dealt out by the key and sorted, and a worker holds one group at a time:
    callers bound the size of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), batch.num_rows]
            if held and held[-1].column(key)[0].as_py() != keys[0]:
                yield from one(held)
                held = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                held.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    yield from one(held)
                    held = []
        if held:
            yield from one(held)

    def one(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = kernel(pa.Table.from_batches(parts).combine_chunks())
        if out is not None and out.num_rows:
            yield out

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after
