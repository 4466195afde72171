"""Domain decomposition: who owns a point, and each part's surrounding rectangle. The part is a column, never a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import checkerboard, core_periodic, regular_checkerboard
from .header import Header

PARTITIONERS = ("serial", "checkerboard", "regular_checkerboard")
DEFAULT_PARTITIONER = "regular_checkerboard"  # a grid's own choice where none is asked for


def owners(spark: SparkSession, h: Header, parts: int, bands: int | None = None, partitioner: str = "checkerboard") -> DataFrame:
    """(n, ix, iy, part) of every core point; n counts them in row-major order.

    equal_regions and equal_area are algorithms of other libraries that aren't described anywhere near; any owner
    table of this shape can stand in for them.
    """
    if partitioner not in PARTITIONERS:
        raise ValueError(f"partitioner {partitioner!r} is none of {', '.join(PARTITIONERS)}")
    if parts < 1 or bands and parts % bands:
        raise ValueError("parts must be positive and a multiple of the bands")
    core = spark.range(h.nx * h.ny).select(F.col("id").alias("n"), (F.col("id") % h.nx).cast("int").alias("ix"), F.floor(F.col("id") / h.nx).cast("int").alias("iy"))
    if partitioner == "serial":
        return core.withColumn("part", F.lit(0))
    if partitioner == "regular_checkerboard":
        return regular_checkerboard(core, h, parts, bands)
    return checkerboard(core, h, parts, bands)


def regular_grid(spark: SparkSession, h: Header) -> DataFrame:
    """(n, ix, iy, lon, lat): the regular grid of the core's size that stands for it when it is cut into parts.

    Latitudes from -80 to 90 degrees, both included; longitudes from 0 to 360, the end left out.
    """
    ix, iy = (F.col("id") % h.nx).cast("int"), F.floor(F.col("id") / h.nx).cast("int")
    return spark.range(h.nx * h.ny).select(F.col("id").alias("n"), ix.alias("ix"), iy.alias("iy"), (ix * (360.0 / h.nx)).alias("lon"), (iy * (170.0 / max(1, h.ny - 1)) - 80.0).alias("lat"))


def check_halo(parts: int, halo: int) -> None:
    if halo < 0 or parts == 1 and halo:
        raise ValueError("the halo must not be negative, and must be 0 for a single part")


def rectangles(owner: DataFrame, halo: int) -> DataFrame:
    """(part, ix_min, ix_max, iy_min, iy_max, n_owned): bounds of the owned points, the halo around them, and one more
    on the east and north for the nodes that complete the cells."""
    b = owner.groupBy("part").agg(F.min("ix").alias("a"), F.max("ix").alias("b"), F.min("iy").alias("c"), F.max("iy").alias("d"), F.count(F.lit(1)).alias("n_owned"))
    return b.select("part", (F.col("a") - halo).alias("ix_min"), (F.col("b") + halo + 1).alias("ix_max"), (F.col("c") - halo).alias("iy_min"), (F.col("d") + halo + 1).alias("iy_max"), "n_owned")


def rectangle_points(rects: DataFrame, owner: DataFrame, h: Header, halo: int) -> DataFrame:
    """(mypart, gi, gj, part, halo, is_ghost) of every point of every rectangle.

    The distance to the nearest point with a node of mypart is at most the halo and only smaller ones need a search, so
    candidates are joined by key on the offsets within halo - 1.
    """
    box = rects.select(F.col("part").alias("mypart"), F.explode(F.sequence("iy_min", "iy_max")).alias("gj"), "ix_min", "ix_max")
    box = box.select("mypart", F.explode(F.sequence("ix_min", "ix_max")).alias("gi"), "gj")
    pi, pj = core_periodic(F.col("gi"), F.col("gj"), h)
    box = box.withColumns({"pi": pi, "pj": pj}).withColumn("key", F.col("pj").cast("bigint") * h.nx + F.col("pi"))
    own = box.join(owner.select(F.col("n").alias("key"), "part"), "key")
    away = (F.col("part") != F.col("mypart")) | (F.col("pi") != F.col("gi")) | (F.col("pj") != F.col("gj"))
    own = own.select("mypart", "gi", "gj", "part", away.alias("is_ghost"))
    if halo < 2:
        return own.withColumn("halo", F.when(F.col("is_ghost"), halo).otherwise(0)).select("mypart", "gi", "gj", "part", "halo", "is_ghost")
    r = halo - 1
    offsets = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in range(-r, r + 1) for y in range(-r, r + 1) if x or y])
    # Ghosts look around; there are few of them, as they line the rectangles.
    asked = own.where("is_ghost").select("mypart", "gi", "gj", F.explode(offsets).alias("o")).select("mypart", "gi", "gj", (F.col("gi") + F.col("o.dx")).alias("ti"), (F.col("gj") + F.col("o.dy")).alias("tj"), F.greatest(F.abs("o.dx"), F.abs("o.dy")).alias("d"))
    inside = own.where("part = mypart").select("mypart", F.col("gi").alias("ti"), F.col("gj").alias("tj"))
    near = asked.join(inside, ["mypart", "ti", "tj"]).groupBy("mypart", "gi", "gj").agg(F.min("d").alias("d"))
    out = own.join(near, ["mypart", "gi", "gj"], "left")
    return out.select("mypart", "gi", "gj", "part", F.when(F.col("is_ghost"), F.coalesce("d", F.lit(halo))).otherwise(0).alias("halo"), "is_ghost")
