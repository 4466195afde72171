"""Grids as text: a header line, then one line per point in row-major order.

Version 1: header `ni nj periodicity E W S N`, points `lat lon water core`; the pivot is given by the user.
Version 2: header `ni nj`, points `lat lon water core I J I_master J_master lat_master lon_master`, indices from 1.

A point's place is that of its line, of one file or of several in order of their names. Spark splits text files by bytes
into blocks and may do so differently each time, so lines are written once with their file, block and place in the block, and
both the counts per block and the numbers come from that table: retried tasks and other splits can't disagree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fold import master
from ..operators.header import Header
from .shared import small_side, written

FIELDS = {1: ("lat", "lon", "water", "core"), 2: ("lat", "lon", "water", "core", "I", "J", "I_master", "J_master", "lat_master", "lon_master")}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a file, a folder or a pattern, numbered from 0 in order of file names and lines."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = written(read, "text-lines")
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("lines").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per block
    offsets = small_side(blocks.select("file", "block", (before - F.col("first")).alias("shift")), 300)
    return lines.join(offsets, ["file", "block"]).select((F.col("id") + F.col("shift")).alias("line_no"), "value")


def write_points(points: DataFrame, h: Header, path: str, files: int) -> None:
    """Points (n, lat, lon, water, core) as a version 1 grid of several files, whose names are in order of the points."""
    head = points.sparkSession.createDataFrame([(-1, f"{h.ni} {h.nj} 0 {h.halo_e} {h.halo_w} {h.halo_s} {h.halo_n}")], "n bigint, value string")
    flag = lambda c: F.col(c).cast("int").cast("string")
    rows = points.select("n", F.concat_ws(" ", F.col("lat").cast("string"), F.col("lon").cast("string"), flag("water"), flag("core")).alias("value"))
    head.unionByName(rows).repartitionByRange(files, "n").sortWithinPartitions("n").select("value").write.text(path)


def header_fields(lines: DataFrame, version: int) -> DataFrame:
    """The header line as one row."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ("ni", "nj") if version == 2 else ("ni", "nj", "periodicity", "halo_e", "halo_w", "halo_s", "halo_n")
    return lines.where("line_no = 0").select(*[F.get(parts, F.lit(k)).cast("int").alias(n) for k, n in enumerate(names)])


def parse_points(lines: DataFrame, version: int = 2) -> DataFrame:
    """(n, fields of the version); n counts the points."""
    if version not in FIELDS:
        raise ValueError(f"text grid version {version} is neither 1 nor 2")
    parts = F.split(F.trim("value"), r"\s+")
    kind = lambda f: "int" if f[0] in "IJ" else "double"
    return lines.where("line_no > 0").select((F.col("line_no") - 1).cast("bigint").alias("n"), *[F.get(parts, F.lit(k)).cast(kind(f)).alias(f) for k, f in enumerate(FIELDS[version])])


def repaired(points: DataFrame) -> DataFrame:
    """Version 2 points whose core flag follows from their master and whose coordinates are the master's."""
    own = (F.col("I") == F.col("I_master")) & (F.col("J") == F.col("J_master"))
    take = F.col("J_master") != 0
    return points.withColumns(
        {
            "core": F.when((F.col("core") == 0) & own, 1.0).when((F.col("core") != 0) & ~own, 0.0).otherwise(F.col("core")),
            "lat": F.when((F.col("lat") != F.col("lat_master")) & take, F.col("lat_master")).otherwise(F.col("lat")),
            "lon": F.when((F.col("lon") != F.col("lon_master")) & take, F.col("lon_master")).otherwise(F.col("lon")),
        }
    )


def file_master(points: DataFrame, ni: int) -> DataFrame:
    """Repaired points with n_file, the master that the file names: itself for core points, -1 for none."""
    named = (F.col("I_master") - 1) + (F.col("J_master") - 1).cast("bigint") * ni
    return points.withColumn("n_file", F.when(F.col("core") != 0, F.col("n")).when(named < 0, F.lit(-1)).otherwise(named).cast("bigint"))


def pivot(points: DataFrame, ni: int, nj: int) -> DataFrame:
    """The pivot as one row: half-way between the point of the last row behind the middle and its master."""
    at = (F.col("J") == nj) & (F.col("I") == ni // 2 + 2)
    return points.where(at).select(((F.col("I") + F.col("I_master") - 2) * 0.5).alias("pivot_i"), ((F.col("J") + F.col("J_master") - 2) * 0.5).alias("pivot_j"))


def halo_widths(points: DataFrame, ni: int, nj: int) -> DataFrame:
    """Rows and columns without a core point at each side, as one row.

    Columns are to be judged between the halo rows only, but that is where all core points are.
    """
    core = points.where("n_file = n").select((F.col("n") % ni).cast("int").alias("ih"), F.floor(F.col("n") / ni).cast("int").alias("jh"))
    return core.agg((F.lit(nj - 1) - F.max("jh")).alias("halo_n"), F.min("ih").alias("halo_w"), F.min("jh").alias("halo_s"), (F.lit(ni - 1) - F.max("ih")).alias("halo_e"))


def mismatches(points: DataFrame, h: Header) -> DataFrame:
    """Points above the south halo whose master or ghost flag differs from the computed one, with a class.

    Classes: `no_master` (the file names none), `beyond_pivot` and `on_pivot_row` (its master lies in the folded half)
    are known oddities of files; `other` is a real one.
    """
    own = points.select("n", "n_file", "core", (F.col("n") % h.ni).cast("int").alias("ih"), F.floor(F.col("n") / h.ni).cast("int").alias("jh"))
    m = master(F.col("ih"), F.col("jh"), h)
    own = own.where(F.col("jh") > h.halo_s).withColumn("m", m).withColumn("n_master", (F.col("m.j").cast("bigint") * h.ni + F.col("m.i")))
    i, j = F.col("n_file") % h.ni, F.floor(F.col("n_file") / h.ni)
    kind = F.when(F.col("n_file") < 0, "no_master").when(j > h.pivot_j, "beyond_pivot").when((j == h.pivot_j) & (i >= h.ni - h.halo_e - h.halo_w), "on_pivot_row").otherwise("other")
    wrong_ghost = (F.col("core") == 0) != (F.col("n_master") != F.col("n"))
    return own.where((F.col("n_master") != F.col("n_file")) | wrong_ghost).select("n", "n_master", "n_file", F.when(F.col("n_master") != F.col("n_file"), kind).alias("kind"), wrong_ghost.alias("wrong_ghost"))
