"""Durable intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths written since each open ``scratch`` block began, innermost last.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none, a local one (a single machine, as in tests) takes a folder
    below the temp folder; on a cluster that is an error, since other machines don't see it.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "lodestone-checkpoints")
    return f"{found.rstrip('/')}/lodestone/{context.applicationId}"


def persist_table(df: DataFrame, name: str, options: dict[str, int] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation. ``options``
    are those of the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes on leaving what ``persist_table`` wrote inside, but for what the given function keeps."""
    written: list[str] = []
    _OPEN.append(written)

    def keep(df: DataFrame) -> DataFrame:
        out = persist_table(df, "kept")
        written.pop()
        return out

    try:
        yield keep
    finally:
        _OPEN.remove(written)
        for path in written:
            _delete(spark, path)


def drop_workspace(spark: SparkSession) -> None:
    """Deletes every intermediate table of this application, once its results are written."""
    _delete(spark, shared_dir(spark))
