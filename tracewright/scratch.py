"""The folder that all executors share, for lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session (tests) gets a temporary folder; a cluster's
    executors would not share one, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "tracewright-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: a lost executor loses nothing, and lineage ends."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


_made: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` as compressed Parquet in the shared folder, read from there: columns, not rows, so that what reads it takes only
    what it needs. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewright-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(_release)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _release() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; its cluster owns the folder
            return
