"""Exact deduplication by stateful streaming (DataFrame functions only).

A file stream over the documents keeps, per SHA-256 digest of the normalised text, one entry in a RocksDB state store:
the largest doc_id seen, where that row lies (file and row number) and how many rows had the digest. Entries never
expire. Digests with more than one row are hits; their rows are read again and grouped by the full bytes, so that two
texts which merely share a digest are told apart and keyed by their text instead.

Defined results: null text counts as empty; a null doc_id loses against any other; rows repeated with one doc_id are
one document and are all marked kept if it stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, scratch_path, small_side, written

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores would set aside megabytes each
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def digest_state(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000) -> DataFrame:
    """(digest, keep_id, keep_file, keep_row, group_size) after all files of `path` went through the stream."""
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    out, checkpoint = scratch_path(spark, "digests"), scratch_path(spark, "digest-state")
    rows = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, since as a plain path only a folder can be streamed
        .select(
            digest(ascii_lower(F.col("text"))).alias("digest"),
            F.struct(F.col("doc_id"), F.col("_metadata.file_path").alias("keep_file"), F.col("_metadata.row_index").alias("keep_row")).alias("at"),
        )
    )
    state = rows.groupBy("digest").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("group_size"))

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/run={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    told = "digest binary, at struct<doc_id:{},keep_file:string,keep_row:bigint>, group_size bigint, batch int"
    seen = spark.read.schema(told.format(schema["doc_id"].dataType.simpleString())).parquet(out) if query.lastProgress else None
    if seen is None:
        return spark.createDataFrame([], told.format(schema["doc_id"].dataType.simpleString())).select("digest", F.col("at.doc_id").alias("keep_id"), "at.keep_file", "at.keep_row", "group_size")
    # Each micro-batch tells the entries that it changed; the last word on a digest holds.
    last = seen.groupBy("digest").agg(F.max_by(F.struct("at", "group_size"), "batch").alias("s")) if seen.select("batch").distinct().count() > 1 else seen.select("digest", F.struct("at", "group_size").alias("s"))
    return last.select("digest", F.col("s.at.doc_id").alias("keep_id"), "s.at.keep_file", "s.at.keep_row", "s.group_size")


def exact_duplicates(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, keep_file, keep_row.

    `digest` may be any function of the normalised text; wrong hits of a weak one are undone by the byte check.
    """
    hits = written(digest_state(spark, path, digest, files_per_batch).where("group_size > 1"), "hits")
    hits = small_side(hits, 160)
    text = ascii_lower(F.col("text"))
    docs = spark.read.parquet(path).select("doc_id", text.alias("norm"))
    keyed = docs.withColumn("digest", digest(F.col("norm")))
    # Full bytes of the hits: one group per digest and text, combined before the shuffle.
    texts = keyed.join(hits.select("digest"), "digest", "left_semi").groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    clash = written(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "clashes")
    size = lambda c, other: F.coalesce(F.col(c), other)
    if clash.isEmpty():
        out = keyed.join(hits, "digest", "left").withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": size("group_size", F.lit(1).cast("long"))})
    else:
        apart = texts.join(small_side(clash, 64), "digest", "left_semi").withColumnsRenamed({"keep_id": "own_id", "group_size": "own_size"})
        out = (
            keyed.join(hits, "digest", "left")
            .join(apart, ["digest", "norm"], "left")
            .withColumns(
                {
                    "keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).when(F.col("own_size").isNotNull(), F.col("own_id")).otherwise(F.col("keep_id")),
                    "group_size": size("own_size", size("group_size", F.lit(1).cast("long"))),
                    "keep_file": F.when(F.col("own_size").isNull(), F.col("keep_file")),
                    "keep_row": F.when(F.col("own_size").isNull(), F.col("keep_row")),
                }
            )
        )
    # With the default digest its hex is at hand; sha2 over the text is then the same expression, computed once.
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(sha256(F.col("norm")))).alias("text_sha256"), "keep_file", "keep_row")
