"""Each part's local grid: its rectangle widened by the grid's own halo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fold import clamp, haloed, in_own_halo, is_ghost, linear, periodic
from .header import Header


def extents(rects: DataFrame, h: Header) -> DataFrame:
    """(mypart, ix_min, ix_max, iy_min, iy_max) with the grid's halo where the rectangle touches an edge; none further
    south than the grid's own."""
    x0, x1, y0, y1 = (F.col(c) for c in ("ix_min", "ix_max", "iy_min", "iy_max"))
    return rects.select(
        F.col("part").alias("mypart"),
        F.when(x0 <= 0, F.least(x0, F.lit(-h.halo_w))).otherwise(x0).alias("ix_min"),
        F.when(x1 >= h.nx - 1, F.greatest(x1, F.lit(h.nx + h.halo_e - 1))).otherwise(x1).alias("ix_max"),
        F.when(y0 <= 0, F.lit(-h.halo_s)).otherwise(y0).alias("iy_min"),
        F.when(y1 >= h.ny - 1, F.greatest(y1, F.lit(h.ny + h.halo_n - 1))).otherwise(y1).alias("iy_max"),
    )


def local_points(ext: DataFrame, rect_points: DataFrame, h: Header) -> DataFrame:
    """Every point of every local grid.

    gi, gj: raw core indices; hi, hj: taken into the grid where beyond its halo; n_haloed, n_master: their linear
    indices with halo; part, halo, is_ghost: from the rectangle's point, the nearest inside for the grid's own halo;
    is_ghost_own_halo: also ghost if the grid says so, but for the south row.
    """
    box = ext.select("mypart", "ix_min", "ix_max", "iy_min", F.col("iy_max").alias("__y1"), F.explode(F.sequence("iy_min", "iy_max")).alias("gj"))
    box = box.select("mypart", F.explode(F.sequence("ix_min", "ix_max")).alias("gi"), "gj", "ix_min", "iy_min", F.col("ix_max").alias("__x1"), "__y1")
    gi, gj = F.col("gi"), F.col("gj")
    hi, hj = haloed(gi, gj, h)
    mi, mj = periodic(gi, gj, h)
    box = box.withColumns({"hi": hi, "hj": hj, "mi": mi, "mj": mj})
    hi, hj = F.col("hi"), F.col("hj")
    edge = in_own_halo(hi, hj, h)
    box = box.withColumns(
        {
            "ki": F.when(edge, clamp(gi, 0, h.nx - 1)).otherwise(gi),
            "kj": F.when(edge, clamp(gj, 0, h.ny - 1)).otherwise(gj),
            "n_haloed": linear(hi, hj, h),
            "n_master": linear(F.col("mi"), F.col("mj"), h),
            "moved": (hi != gi) | (hj != gj),
            "is_cell": (gi < F.col("__x1")) & (gj < F.col("__y1")),
            "grid_ghost": is_ghost(hi + h.halo_w, hj + h.halo_s, h),
        }
    )
    rect = rect_points.select("mypart", F.col("gi").alias("ki"), F.col("gj").alias("kj"), "part", "halo", F.col("is_ghost").alias("rect_ghost"))
    out = box.join(rect, ["mypart", "ki", "kj"])
    ghost = F.col("rect_ghost") | F.col("moved")
    south = (hj < 0) & (hi >= 0) & (hi < h.nx)
    return out.withColumn("is_ghost", ghost).select(
        "mypart",
        (gi - F.col("ix_min")).alias("ix"),
        (gj - F.col("iy_min")).alias("iy"),
        "gi",
        "gj",
        "hi",
        "hj",
        "n_haloed",
        "n_master",
        "part",
        "halo",
        "is_ghost",
        F.when(south, F.col("is_ghost")).otherwise(F.col("is_ghost") | F.col("grid_ghost")).alias("is_ghost_own_halo"),
        F.lit(True).alias("is_node"),
        "is_cell",
    )


def counters(points: DataFrame) -> DataFrame:
    """Nodes and cells in use per part, real and ghost."""
    n = lambda c: F.count_if(c)
    g = F.col("is_ghost")
    return points.groupBy("mypart").agg(n(F.col("is_node")).alias("nodes"), n(F.col("is_node") & ~g).alias("real_nodes"), n(F.col("is_node") & g).alias("ghost_nodes"), n("is_ghost_own_halo").alias("ghost_flags"), n(F.col("is_cell") & ~g).alias("real_cells"), n(F.col("is_cell") & g).alias("ghost_cells"))


def with_index(local: DataFrame) -> DataFrame:
    """Local points with n_local, their place in row-major order of the local grid."""
    widths = local.groupBy("mypart").agg((F.max("ix") + 1).alias("nx_local"))  # a row for each part
    return local.join(widths, "mypart").withColumn("n_local", F.col("iy").cast("bigint") * F.col("nx_local") + F.col("ix")).drop("nx_local")
