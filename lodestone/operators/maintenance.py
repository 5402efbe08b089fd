"""Index maintenance as differences of snapshots (collection, path, hash).

``current`` is what a scan finds; ``stored`` is what the index has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["collection", "path"]


def classify(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Each current path as new, changed or unchanged, and moved where a new path holds the
    content of a stored path that is gone from the same collection."""
    old = stored.select(*KEY, F.col("hash").alias("old_hash"))
    rows = current.select(*KEY, "hash").join(old, KEY, "left")
    gone = stored.join(current.select(*KEY), KEY, "left_anti").groupBy("collection", "hash").agg(F.min("path").alias("old_path"))
    rows = rows.join(gone, ["collection", "hash"], "left")
    # One path takes over a departed one; further copies of its content are new.
    turn = F.row_number().over(Window.partitionBy("collection", "hash", F.col("old_hash").isNull()).orderBy("path"))
    state = F.when(F.col("old_hash") == F.col("hash"), "unchanged").when(F.col("old_hash").isNotNull(), "changed").when(F.col("old_path").isNotNull() & (F.col("turn") == 1), "moved").otherwise("new")
    rows = rows.withColumn("turn", turn).withColumn("state", state)
    return rows.select(*KEY, "hash", "state", F.when(F.col("state") == "moved", F.col("old_path")).alias("old_path"))


def unseen_content(current: DataFrame, content: DataFrame) -> DataFrame:
    """Hashes that no stored content has, once each: only these are converted and chunked."""
    return current.select("hash").distinct().join(content.select("hash"), "hash", "left_anti")


def latest(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Upsert: of the rows of a key, the last in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() if isinstance(c, str) else c for c in order])
    return rows.withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn")


def stale(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored paths that the scan doesn't find any more."""
    return stored.join(current.select(*KEY), KEY, "left_anti")


def pruned(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Stored documents of collections that aren't configured any more."""
    return stored.join(configured.select("collection"), "collection", "left_anti")


def orphans(content: DataFrame, documents: DataFrame) -> DataFrame:
    """Content that no document refers to."""
    return content.join(documents.select("hash"), "hash", "left_anti")


def backfill(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks (hash, …) with the collection, path and title of the first document of their content."""
    first = documents.groupBy("hash").agg(F.min_by(F.struct("collection", "path", "title"), "doc_id").alias("doc"))
    return chunks.join(first, "hash").select(*chunks.columns, "doc.*")
