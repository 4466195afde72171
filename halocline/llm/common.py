"""Shared folders, written tables and size-checked broadcasts used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times a row size stay below this; otherwise the join shuffles.
BROADCAST_BYTES = 32 << 20

BATCH_BYTES = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(batches, size: int) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, turned into Python objects `size` at a time; memory goes back after each batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, size).columns), strict=True)
        del batch
        pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python in batches of BATCH_BYTES at most; set where it allows more, and it stays so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def fresh(columns: list[str], name: str) -> str:
    """`name` with underscores before it, until none of `columns` has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where it is unset and all runs in one process (tests), one of our own."""
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
    """Cut the lineage: write the rows to the shared folder and read them back, so that lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def drop_written(*tables: DataFrame) -> None:
    """Remove tables made by written() that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the counted rows fit in `limit` bytes; beyond it Spark's shuffle join is used."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def ascii_lower(text):
    """Lower-case A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
