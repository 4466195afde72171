"""Content hashes of grids.

The published hash is MD5 over the arrangement, all latitudes and all longitudes as little-endian doubles in row-major
order. MD5 can't be combined from parts, so the bytes must pass one place in order; they are sent as sorted chunks of
packed doubles through one task that keeps nothing but the running digest. `chunked_uid` is a hash of our own that
combines: the digest of the chunks' digests.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16


def chunks(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(field, chunk, bytes): packed doubles; field 0 has the latitudes, 1 the longitudes."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        return pd.DataFrame({"field": [0, 1], "chunk": int(pdf["chunk"].iloc[0]), "bytes": [pdf[c].to_numpy("<f8").tobytes() for c in ("lat", "lon")]})

    cut = points.select("n", "lat", "lon", F.floor(F.col("n") / chunk).alias("chunk"))
    return cut.groupBy("chunk").applyInPandas(packed, "field int, chunk bigint, bytes binary")


def content_uid(points: DataFrame, arrangement: str) -> DataFrame:
    """One row: the published hash of points (n, lon, lat)."""

    def run(batches):
        digest = hashlib.md5(arrangement.encode())
        for pdf in batches:
            for part in pdf["bytes"]:
                digest.update(part)
        yield pd.DataFrame({"uid": [digest.hexdigest()]})

    # An exchange in front, so that the packing is spread and only packed bytes reach the one task.
    return chunks(points).repartition(1).sortWithinPartitions("field", "chunk").select("bytes").mapInPandas(run, "uid string")


def chunked_uid(points: DataFrame, arrangement: str) -> DataFrame:
    """One row: a combinable hash, the same whatever the partitioning."""
    each = chunks(points).select("field", "chunk", F.md5("bytes").alias("d"))
    return each.agg(F.md5(F.concat(F.lit(arrangement), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("field", "chunk", "d"))), lambda x: x["d"]), "")).cast("binary")).alias("uid"))


def text_uid(points: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """One row: how many points and a sum of hashes over scaled whole coordinates, in any order."""
    key = F.concat_ws(":", F.col("n").cast("string"), F.round(F.col("lat") * scale).cast("bigint").cast("string"), F.round(F.col("lon") * scale).cast("bigint").cast("string"))
    piece = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return points.agg(F.count(F.lit(1)).alias("points"), F.sum(piece).alias("digest"))


def uid_matches(points: DataFrame, arrangement: str, uid: str) -> bool:
    return content_uid(points, arrangement).first()["uid"] == uid


def checked_uid(points: DataFrame, arrangement: str, uid: str, validate: bool = False, compute: bool = False) -> str:
    """The hash that a grid goes by: the one given, or, if asked to, checked against the points (an error if they
    differ) or computed from them in its place. Checking comes before computing."""
    if not validate and not compute:
        return uid
    own = content_uid(points, arrangement).first()["uid"]
    if validate and own != uid:
        raise ValueError(f"the points have the hash {own}, not {uid}")
    return own


