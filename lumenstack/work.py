"""The shared work folder: where lineage is cut, so that a lost executor costs one step at most."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir.

    Only a local session may go without that setting; it then uses a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints/lumenstack"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: later uses neither repeat its work nor
    depend on one executor's disk."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.written_to = path
    return read


def forget(df: DataFrame) -> None:
    """Removes what materialise() wrote for df, of which nothing that is still to be computed may read."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
