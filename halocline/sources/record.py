"""The columnar grid record: a header row and a table of points, as Parquet in two folders of one path."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import flag_byte, flag_set
from ..operators.header import Header

VERSION = 0
HEADER = "version int, grid string, ni int, nj int, halo_n int, halo_w int, halo_s int, halo_e int, pivot_i double, pivot_j double"
POINTS = "n bigint, lon double, lat double, flags int"


def check_points(points: DataFrame, h: Header) -> DataFrame:
    """One row: how many points there are, whether they fill the grid once, and how many lack a coordinate."""
    return points.agg(
        F.count(F.lit(1)).alias("points"),
        ((F.count(F.lit(1)) == h.size) & (F.min("n") == 0) & (F.max("n") == h.size - 1) & (F.countDistinct("n") == h.size)).alias("complete"),
        F.count_if(F.col("lon").isNull() | F.col("lat").isNull()).alias("missing"),
    )


def write_record(points: DataFrame, h: Header, path: str, compression: str = "zstd") -> None:
    """Points (n, lon, lat, ghost, water, invalid) and header; raises if the points don't fill the grid."""
    seen = check_points(points, h.check()).first()
    if not seen["complete"] or seen["missing"]:
        raise ValueError(f"{h.grid}: {seen['points']} points for {h.size}, {seen['missing']} without coordinates")
    flags = flag_byte(ghost=F.col("ghost"), water=F.col("water"), invalid=F.col("invalid"))
    out = points.select("n", "lon", "lat", flags.alias("flags"))
    # Ranges of n, so that files hold bands of rows and a filter on n skips files.
    out.repartitionByRange("n").sortWithinPartitions("n").write.option("compression", compression).parquet(f"{path}/points")
    points.sparkSession.createDataFrame([(VERSION, *asdict(h).values())], HEADER).coalesce(1).write.parquet(f"{path}/header")


def read_record(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """The header and the decoded points; other versions than 0 are refused."""
    row = spark.read.schema(HEADER).parquet(f"{path}/header").first().asDict()
    if row.pop("version") != VERSION:
        raise ValueError(f"{path}: only version {VERSION} of the record is known")
    h = Header(**row)
    return h, decoded(spark.read.schema(POINTS).parquet(f"{path}/points"), h)


def decoded(points: DataFrame, h: Header) -> DataFrame:
    """Points with indices in both frames and flags as booleans."""
    ih, jh = (F.col("n") % h.ni).cast("int"), F.floor(F.col("n") / h.ni).cast("int")
    return points.select("n", ih.alias("ih"), jh.alias("jh"), (ih - h.halo_w).alias("i"), (jh - h.halo_s).alias("j"), "lon", "lat", *[flag_set(F.col("flags"), f).alias(f) for f in ("ghost", "water", "invalid")])
