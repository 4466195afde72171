"""Tables written to the folder that all executors share, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder; where neither is set and all runs in one process (tests), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='halocline-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/halocline/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: what follows doesn't compute them again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the counted rows fit in `limit` bytes; beyond it Spark's shuffle join is used."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
