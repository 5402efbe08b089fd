"""Intermediate tables as Parquet in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that Spark hands to a Python worker at once (the default is 64 MB).
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small in this session: a worker holds a batch several times."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; without it a local session takes one below the temp folder, a cluster can't run."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "lodestone-tables")
    return f"{found.rstrip('/')}/lodestone/{context.applicationId}/tables"


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later uses read it, and lost executors cost a reread."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files at ``path``: another value if they are written anew."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = system.listStatus(at) if system.getFileStatus(at).isDirectory() else [system.getFileStatus(at)]
    return ";".join(sorted(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}" for f in files))
