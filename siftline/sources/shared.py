"""The folder that driver and executors share, for rows that a query reads more than once."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset and the master is local, a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def own_path(spark: SparkSession, name: str) -> str:
    """A path of its own in this application's part of the shared folder, which goes when the process ends."""
    folder = f"{shared_dir(spark)}/siftline-{spark.sparkContext.applicationId}"
    if folder not in _own:
        _own.add(folder)
        atexit.register(removed, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them again.

    This cuts lineage, so that a lost executor costs only the tasks it ran, and makes several readers share one
    computation. Columns that a reader doesn't want are not read.
    """
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, by whatever file system has it."""
    context = spark.sparkContext
    if context._jsc is not None:  # a stopped context can't reach the file system any more
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
