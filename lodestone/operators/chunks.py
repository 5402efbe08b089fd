"""Overlapping character windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Above the number of chunks that the longest possible text has.
MOST_CHUNKS = 1 << 24


def window_chunks(docs: DataFrame, *, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of ``body`` as rows (other columns kept): seq_id, body. Null and empty texts have none."""
    step = size - overlap
    n = F.when(F.length("body") <= size, 1).otherwise(F.ceil((F.length("body") - overlap) / step)).cast("int")
    seqs = F.when(F.length("body") > 0, F.sequence(F.lit(0), n - 1))
    rows = docs.withColumn("seq_id", F.explode(seqs))
    return rows.withColumn("body", F.substring("body", F.col("seq_id") * step + 1, F.lit(size)))


def with_chunk_ids(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """A chunk_id that follows from the document's number and place, the same in every run.

    No text has as many windows as there is room for; numbers of documents may have 39 bits.
    """
    return chunks.withColumn("chunk_id", F.col(key) * MOST_CHUNKS + F.col("seq_id"))
