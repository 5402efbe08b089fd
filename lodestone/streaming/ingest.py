"""Files that arrive over time (an extension): a stream of documents kept as the latest snapshot.

Each file is converted as in a batch scan. A micro-batch is written once under its number,
so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.maintenance import latest
from lodestone.sources.files import is_supported, to_markdown

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, base: str, collection: str) -> DataFrame:
    """(collection, path, hash, content, modified_at) of supported files as they appear below ``base``."""
    rows = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(base)
    rows = rows.filter(is_supported(F.col("path")))
    return rows.select(F.lit(collection).alias("collection"), "path", F.sha2("content", 256).alias("hash"), "content", F.col("modificationTime").alias("modified_at"))


def ingest(files: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Converts what has arrived and appends it to the Parquet ``table``, one folder for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        to_markdown(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, table: str) -> DataFrame:
    """The latest version of each document in ``table``."""
    return latest(spark.read.parquet(table), ["collection", "path"], F.col("modified_at").desc(), F.col("batch").desc())
