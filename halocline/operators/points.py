"""Point relations: the index spine of a grid, masters and ghosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import is_ghost, master
from .header import Header


def spine(spark: SparkSession, h: Header) -> DataFrame:
    """(n, ih, jh, i, j) of every point in row-major order, with the halo."""
    n = F.col("id")
    ih, jh = F.coalesce(n % h.ni, F.lit(0)).cast("int"), F.floor(n / h.ni).cast("int")  # remainders pass as nullable
    return spark.range(h.size).select(n.alias("n"), ih.alias("ih"), jh.alias("jh"), (ih - h.halo_w).alias("i"), (jh - h.halo_s).alias("j"))


def with_master(points: DataFrame, h: Header) -> DataFrame:
    """Adds the master's indices in the halo frame (mi, mj) and its linear index n_master."""
    m = points.withColumn("m", master(F.col("ih"), F.col("jh"), h))
    return m.withColumns({"mi": F.col("m.i"), "mj": F.col("m.j"), "n_master": F.col("m.j").cast("bigint") * h.ni + F.col("m.i")}).drop("m")


def with_ghost(points: DataFrame, h: Header) -> DataFrame:
    return points.withColumn("ghost", is_ghost(F.col("ih"), F.col("jh"), h))


def grid_points(spark: SparkSession, h: Header, lon, lat, water) -> DataFrame:
    """A grid whose coordinates and mask are expressions of the master's indices (mi, mj)."""
    return with_ghost(with_master(spine(spark, h), h), h).withColumns({"lon": lon, "lat": lat, "water": water})
