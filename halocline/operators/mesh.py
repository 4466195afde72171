"""Meshes: nodes, cells and the link from ghosts to owners, for all parts in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import clamp, core_of_linear, core_periodic
from ..functions.geometry import normalised
from ..sources.shared import written
from .header import Header


def numbered(points: DataFrame, ghost: str, name: str) -> DataFrame:
    """Points with a number in their part: real ones first, then ghosts, both in row-major order.

    Rows of the grid are counted; a number is the count of all rows before, plus the place in the own row. So no window
    holds more points than a row, and what is summed over a part is a count per row. The points are used for both and
    written once, so that what made them isn't computed again, twice as often with every numbering.
    """
    points = written(points, "unnumbered")
    rows = points.groupBy("mypart", "iy").agg(F.count_if(~F.col(ghost)).alias("real"), F.count_if(ghost).alias("ghosts"))
    part = Window.partitionBy("mypart")
    before = part.orderBy("iy").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = rows.select("mypart", "iy", sums("real").alias("first_real"), (F.sum("real").over(part) + sums("ghosts")).alias("first_ghost"))
    place = F.row_number().over(Window.partitionBy("mypart", "iy", ghost).orderBy("ix"))
    first = F.when(F.col(ghost), F.col("first_ghost")).otherwise(F.col("first_real"))
    return points.join(offsets, ["mypart", "iy"]).withColumn(name, (first + place - 1).cast("bigint")).drop("first_real", "first_ghost")


def nodes(points: DataFrame, owner: DataFrame, h: Header, parts: int) -> DataFrame:
    """Mesh nodes without coordinates: indices, owner part, ghost flag and where the owner's value is to be found.

    For ghosts, the part is that of their master's nearest core point, and remote_idx is unknown (-1) until linked;
    a single part knows it at once.
    """
    n = numbered(points, "is_ghost", "inode")
    mi, mj = core_of_linear(F.col("n_master"), h)
    ci, cj = core_periodic(clamp(mi, 0, h.nx - 1), clamp(mj, 0, h.ny - 1), h)
    n = n.withColumn("key", cj.cast("bigint") * h.nx + ci).join(owner.select(F.col("n").alias("key"), F.col("part").alias("master_part")), "key")
    ghost = F.col("is_ghost_own_halo")
    return n.select(
        "mypart",
        "inode",
        "ix",
        "iy",
        "gi",
        "gj",
        "hi",
        "hj",
        "n_master",
        (F.col("n_haloed") + 1).alias("glb_idx"),
        (F.when(ghost, F.col("n_master")).otherwise(F.col("n_haloed")) + 1).alias("master_glb_idx"),
        F.when(ghost, F.when(F.lit(parts == 1), F.col("n_master")).otherwise(F.lit(-1))).otherwise(F.col("inode")).cast("bigint").alias("remote_idx"),
        F.when(ghost, F.lit(0) if parts == 1 else F.col("master_part")).otherwise(F.col("part")).alias("part"),
        ghost.alias("ghost"),
        "is_ghost",
        "halo",
        "is_cell",
    )


def with_coordinates(mesh_nodes: DataFrame, grid: DataFrame, h: Header, lon00: float) -> DataFrame:
    """Nodes with lon, lat (the master's, longitude shifted by half of the grid), water and the node flags.

    grid: points (n, ih, jh, lon, lat, water). The row's longitude at core i = 1 decides the western window; there is
    one per row of the grid.
    """
    row1 = grid.where(F.col("ih") == 1 + h.halo_w).select((F.col("jh") - h.halo_s).alias("row"), normalised(F.col("lon"), F.lit(lon00 - 180.0)).alias("lon1"))
    at_master = grid.select(F.col("n").alias("n_master"), F.col("lon").alias("m_lon"), F.col("lat").alias("m_lat"))
    at_haloed = grid.select((F.col("n") + 1).alias("glb_idx"), F.col("water"))
    _, mj = core_of_linear(F.col("n_master"), h)
    out = mesh_nodes.withColumn("mj", mj).join(at_master, "n_master").join(at_haloed, "glb_idx")
    out = out.join(row1.select(F.col("row").alias("mj"), F.col("lon1").alias("lon1_master")), "mj").join(row1.select(F.col("row").alias("gj"), F.col("lon1").alias("lon1_own")), "gj", "left")
    widths = mesh_nodes.groupBy("mypart").agg((F.max("ix") + 1).alias("nx_local"))  # a row for each part
    out = out.join(widths, "mypart")
    west = lambda lon1: F.when(lon1 < lon00 - 10, F.lit(lon00 - 20.0)).otherwise(F.lit(lon00 - 90.0))
    east = F.lit(lon00 + 90.0)
    lon = normalised(F.col("m_lon"), F.when(F.col("gi") < h.nx // 2, west(F.col("lon1_master"))).otherwise(east))
    other = normalised(F.col("m_lon"), F.when(F.col("gi") < F.floor(F.col("nx_local") / 2), west(F.coalesce("lon1_own", "lon1_master"))).otherwise(east))
    out = out.withColumns({"lon": lon, "lat": F.col("m_lat"), "lon_master": other})
    moved = F.col("ghost") & (F.col("glb_idx") - 1 != F.col("n_master"))
    hi, hj = F.col("hi"), F.col("hj")
    north = moved & (hj >= h.ny)
    folded = moved & ((hi >= h.nx) | (hi < 0) | (hj >= h.ny))
    west_bc, east_bc = hi <= 0, (hi > 0) & (hj >= h.nx)  # the second compares j on purpose: it is what users have seen
    return out.withColumns(
        {
            "f_ghost": F.col("ghost"),
            "f_periodic": folded & ~(F.abs(F.col("lon_master") - F.col("lon")) < 1e-12),
            "f_east": (north & (F.col("lon") > lon00 + 90)) | east_bc,
            "f_west": (north & ~(F.col("lon") > lon00 + 90)) | west_bc,
            "f_bc": west_bc | east_bc,
            "f_land": ~F.col("water"),
            "f_water": F.col("water"),
        }
    ).drop("mj", "m_lon", "m_lat", "lon1_master", "lon1_own", "nx_local", "lon_master")


def is_patched(h: Header) -> bool:
    """Whether the point behind the middle of the last core row is real: the fold then lies between two rows."""
    i, j = h.nx // 2 + 1 + h.halo_w, h.ny - 1 + h.halo_s
    beyond = j > h.pivot_j or j == h.pivot_j and i > h.pivot_i
    if beyond:
        i, j = int(2 * h.pivot_i) - i, int(2 * h.pivot_j) - j
    return not beyond


def cells(mesh_nodes: DataFrame, h: Header, water: bool = False) -> DataFrame:
    """Quadrilaterals: number (real before ghost, row-major by the south-western node), corners, part, halo and flags.

    Each node is dealt to the cells of which it is a corner and the cells are grouped: one shuffle for all corners.
    """
    corner = F.explode(F.array(*[F.struct((F.col("ix") - di).alias("ix"), (F.col("iy") - dj).alias("iy"), F.lit(k).alias("k")) for k, (di, dj) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]))
    cols = ["mypart", "inode", "part", "halo", "is_ghost", "is_cell", "gi", "gj"] + ["f_water"] * water
    dealt = mesh_nodes.select(corner.alias("c"), *cols).where((F.col("c.ix") >= 0) & (F.col("c.iy") >= 0))
    at = lambda k, col: F.max(F.when(F.col("c.k") == k, F.col(col)))
    flags = [F.bool_or("f_water").alias("f_water"), F.bool_or(~F.col("f_water")).alias("f_land")] if water else []
    g = dealt.groupBy("mypart", F.col("c.ix").alias("ix"), F.col("c.iy").alias("iy")).agg(*[at(k, "inode").alias(f"node{k}") for k in range(4)], at(0, "part").alias("part_sw"), at(2, "part").alias("part_ne"), at(0, "is_ghost").alias("ghost_sw"), at(0, "is_cell").alias("is_cell"), at(0, "gi").alias("gi"), at(0, "gj").alias("gj"), F.max("halo").alias("halo_max"), *flags)
    g = numbered(g.where("is_cell"), "ghost_sw", "jcell")
    folded = F.col("gj") >= h.ny - 1
    keep = F.lit(is_patched(h)) & (F.col("gi") < h.nx // 2)
    south = F.when(F.col("gi") < 0, -F.col("gi")).when(F.col("gi") >= h.nx, F.col("gi") - (h.nx - 1)).otherwise(0)
    return g.select(
        "mypart",
        "jcell",
        ((F.col("gj") + h.halo_s).cast("bigint") * h.ni + F.col("gi") + h.halo_w + 1).alias("glb_idx"),
        *[F.col(f"node{k}") for k in range(4)],
        F.when(folded & ~keep, F.col("part_ne")).otherwise(F.col("part_sw")).alias("part"),
        F.when(F.col("gj") < 0, south).otherwise(F.col("halo_max")).cast("int").alias("halo"),
        (folded & ~keep).alias("f_ghost"),
        *(["f_water", "f_land"] if water else []),
    )


def linked(mesh_nodes: DataFrame) -> DataFrame:
    """(mypart, inode, asked_part, master_glb_idx, remote_idx, remote_part, remote_glb_idx) of every ghost.

    Owners are the nodes that aren't ghosts, by part and master; remote columns are null where none is found.
    """
    owner = mesh_nodes.where(~F.col("ghost")).select(F.col("mypart").alias("p"), F.col("master_glb_idx").alias("m"), F.col("inode").alias("remote_idx"), F.col("part").alias("remote_part"), F.col("glb_idx").alias("remote_glb_idx"))
    ghost = mesh_nodes.where("ghost").select("mypart", "inode", F.col("part").alias("asked_part"), "master_glb_idx")
    return ghost.join(owner, (F.col("asked_part") == F.col("p")) & (F.col("master_glb_idx") == F.col("m")), "left").drop("p", "m")


def with_links(mesh_nodes: DataFrame) -> DataFrame:
    """Nodes whose ghosts have taken over remote_idx, part and glb_idx of the node that owns them.

    A ghost without an owner keeps remote_idx -1; check_links finds those.
    """
    found = linked(mesh_nodes).where("remote_idx is not null").select("mypart", "inode", F.col("remote_idx").alias("r_idx"), F.col("remote_part").alias("r_part"), F.col("remote_glb_idx").alias("r_glb"))
    taken = {"remote_idx": F.coalesce("r_idx", "remote_idx"), "part": F.coalesce("r_part", "part"), "glb_idx": F.coalesce("r_glb", "glb_idx")}
    ghosts = mesh_nodes.where("ghost").join(found, ["mypart", "inode"], "left").withColumns(taken).select(*mesh_nodes.columns)
    return mesh_nodes.where(~F.col("ghost")).unionByName(ghosts)


def check_links(mesh_nodes: DataFrame) -> None:
    """Raises if a ghost has no owner or an owner is claimed twice."""
    lost = linked(mesh_nodes).where("remote_idx is null").count()
    if lost or not duplicate_owners(mesh_nodes).isEmpty():
        raise ValueError(f"{lost} ghosts have no owner, or owners are claimed twice")


def exchanged(mesh_nodes: DataFrame, values: DataFrame) -> DataFrame:
    """Halo exchange: values (mypart, inode, value) of real nodes delivered to their ghosts."""
    from_owner = values.select(F.col("mypart").alias("asked_part"), F.col("inode").alias("remote_idx"), "value")
    return linked(mesh_nodes).join(from_owner, ["asked_part", "remote_idx"]).select("mypart", "inode", "value")


def duplicate_owners(mesh_nodes: DataFrame) -> DataFrame:
    """Owner keys that more than one node claims; there must be none."""
    return mesh_nodes.where(~F.col("ghost")).groupBy("mypart", "master_glb_idx").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
