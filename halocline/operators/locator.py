"""Which cell a point lies in: a quadtree over the cells, and a join of points and cells on its leaves.

Tiles of longitude and latitude are squares that halve from level to level. A cell is entered into every tile that its
box touches; tiles with more than `limit` cells are split into four, and only their entries go on, down to `deepest`.
So where cells are dense the tiles are small, and a point meets about as many cells everywhere. Boxes that are at least a
tile wide and high, or LONG tiles long, stay in the tile when it is split: smaller tiles would repeat them and not part
them (near the fold many boxes are as wide as the globe). A point has one tile a level; it is dealt to the levels that
have entries, and meets a cell in one of them at most. Leaves with many points are dealt to several tasks: their points
by a hash, their few cells to each.

Points on common sides lie in the cell that comes first by row and column. Points in no cell have null indices, and so
have those with a null, infinite or undefined coordinate. Ids of points are distinct.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import normalised
from ..sources.shared import small_side, written
from .quality import CORNERS

COARSEST = 8.0  # degrees of a tile of level 0; 360 is a multiple of it
LIMIT, DEEPEST, HOT = 32, 12, 100_000  # cells a leaf, levels, points of a leaf that one task takes
LONG = 16  # tiles: a longer box does not go on to smaller ones
BOX = ("x0", "x1", "y0", "y1")


def _left_of(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax) >= 0


def cell_boxes(cells: DataFrame) -> DataFrame:
    """Cells (ih, jh, x_* and y_* of the corners) with longitudes brought near the south-western corner's, and their box."""
    west = F.col("lon_sw") - 180.0
    box = cells.select("ih", "jh", *[normalised(F.col(f"lon_{c}"), west).alias(f"x_{c}") for c in CORNERS], *[F.col(f"lat_{c}").alias(f"y_{c}") for c in CORNERS])
    xs, ys = [F.col(f"x_{c}") for c in CORNERS], [F.col(f"y_{c}") for c in CORNERS]
    return box.withColumns({"x0": F.least(*xs), "x1": F.greatest(*xs), "y0": F.least(*ys), "y1": F.greatest(*ys)})


def tile_key(tx: Column, level: Column | int) -> Column:
    """A tile's column, counted around the globe."""
    return F.pmod(tx, F.shiftleft(F.lit(int(360 / COARSEST)), level) if isinstance(level, int) else F.expr(f"shiftleft({int(360 / COARSEST)}, level)"))


def first_level(cells: int, limit: int = LIMIT) -> int:
    """The level whose tiles would hold about half of `limit` cells, were they spread evenly over the globe."""
    tiles = (360 / COARSEST) * (180 / COARSEST)
    return max(0, min(DEEPEST, round(log(max(1.0, 2 * cells / limit / tiles), 4))))


def quadtree(boxes: DataFrame, limit: int = LIMIT, deepest: int = DEEPEST) -> tuple[DataFrame, list[int]]:
    """Entries (boxes with level, tx, ty, key) that points are compared with, and the levels that have any."""
    boxes = written(boxes, "cell-boxes")
    level = min(deepest, first_level(boxes.count(), limit))
    size = COARSEST / 2**level
    reach = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    entries = boxes.withColumn("tx", F.explode(reach("x0", "x1"))).withColumn("ty", F.explode(reach("y0", "y1")))
    leaves, levels = [], []
    while True:
        entries = written(entries.withColumn("level", F.lit(level)).withColumn("key", tile_key(F.col("tx"), level)), "tile-entries")
        sides = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        parted = (F.least(*sides) < size) & (F.greatest(*sides) < LONG * size)
        dense = entries.groupBy("key", "ty").agg(F.count(F.lit(1)).alias("cells"), F.max(parted).alias("parted")).where((F.col("cells") > limit) & F.col("parted")).select("key", "ty")
        if level >= deepest or dense.isEmpty():
            return reduce(DataFrame.unionByName, [*leaves, entries]), [*levels, level]
        dense = small_side(written(dense, "dense-tiles"), 24)
        marked = entries.join(dense.withColumn("dense", F.lit(True)), ["key", "ty"], "left").withColumn("dense", F.coalesce(F.col("dense") & parted, F.lit(False)))
        leaves.append(marked.where("not dense").select(*entries.columns))
        levels.append(level)
        level, size = level + 1, size / 2
        halves = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c)
        finer = marked.where("dense").select(*boxes.columns, halves("tx"), "ty").select(*boxes.columns, "tx", halves("ty"))
        touches = lambda c, a, b: (F.col(c) * size <= F.col(b)) & ((F.col(c) + 1) * size > F.col(a))
        entries = finer.where(touches("tx", "x0", "x1") & touches("ty", "y0", "y1"))


def located(where: DataFrame, cells: DataFrame, limit: int = LIMIT, deepest: int = DEEPEST, hot: int = HOT) -> DataFrame:
    """`where` (id, lon, lat) with the indices (ih, jh) of a counter-clockwise cell that holds each point, else null."""
    entries, levels = quadtree(cell_boxes(cells), limit, deepest)
    known = where.select("id", "lon", "lat").where("not isnan(lon) and not isnan(lat) and abs(lon) < 1e6 and abs(lat) <= 90")
    tiles = [F.struct(F.lit(k).alias("level"), tile_key(F.floor(F.col("lon") / (COARSEST / 2**k)), k).alias("key"), F.floor(F.col("lat") / (COARSEST / 2**k)).alias("ty")) for k in levels]
    asked = known.select("id", "lon", "lat", F.explode(F.array(*tiles)).alias("t")).select("id", "lon", "lat", "t.*")
    tile = ["level", "key", "ty"]
    heat = asked.groupBy(*tile).agg(F.count(F.lit(1)).alias("points")).where(F.col("points") > hot)
    heat = small_side(written(heat.select(*tile, F.ceil(F.col("points") / hot).cast("int").alias("tasks")), "hot-tiles"), 32)  # one row for `hot` points at most
    tasks = F.coalesce("tasks", F.lit(1))
    asked = asked.join(heat, tile, "left").withColumn("task", F.pmod(F.xxhash64("id"), tasks).cast("int")).drop("tasks")
    entered = entries.join(heat, tile, "left").withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("tasks", "tx")
    both = asked.join(entered, [*tile, "task"])
    px, inside = normalised(F.col("lon"), F.col("x0") - 1e-9), F.lit(True)
    for a, b in zip(CORNERS, (*CORNERS[1:], CORNERS[0]), strict=True):
        inside = inside & _left_of(F.col(f"x_{a}"), F.col(f"y_{a}"), F.col(f"x_{b}"), F.col(f"y_{b}"), px, F.col("lat"))
    hit = both.where(inside & (px <= F.col("x1"))).groupBy("id").agg(F.min(F.struct("jh", "ih")).alias("cell"))
    return where.join(hit, "id", "left").select(*[where[c] for c in where.columns], F.col("cell.ih").alias("ih"), F.col("cell.jh").alias("jh"))


def in_parts(found: DataFrame, owner: DataFrame, halo_w: int, halo_s: int) -> DataFrame:
    """Located points with the part (owner: ix, iy, part) that owns the south-western node of their cell; null outside."""
    own = owner.select((F.col("ix") + halo_w).alias("ih"), (F.col("iy") + halo_s).alias("jh"), "part")
    return found.join(own, ["ih", "jh"], "left").select(*[found[c] for c in found.columns], "part")


def part_outline(cells: DataFrame, owner: DataFrame, halo_w: int, halo_s: int) -> DataFrame:
    """(part, ax, ay, bx, by): the sides of each part's cells that no other of its cells shares, counter-clockwise: the
    polygons around the part, with those around its holes."""
    own = owner.select((F.col("ix") + halo_w).alias("ih"), (F.col("iy") + halo_s).alias("jh"), "part")
    box = cell_boxes(cells).join(own, ["ih", "jh"])
    node = lambda di, dj: F.struct((F.col("jh") + dj).alias("j"), (F.col("ih") + di).alias("i"))
    at = {"sw": node(0, 0), "se": node(1, 0), "ne": node(1, 1), "nw": node(0, 1)}
    sides = []
    for a, b in zip(CORNERS, (*CORNERS[1:], CORNERS[0]), strict=True):
        ends = [F.col(f"{axis}_{c}").alias(f"{p}{axis}") for p, c in (("a", a), ("b", b)) for axis in "xy"]
        sides.append(F.struct(F.least(at[a], at[b]).alias("low"), F.greatest(at[a], at[b]).alias("high"), *ends))
    dealt = box.select("part", F.explode(F.array(*sides)).alias("s"))
    once = dealt.groupBy("part", "s.low", "s.high").agg(F.count(F.lit(1)).alias("cells"), *[F.first(f"s.{c}").alias(c) for c in ("ax", "ay", "bx", "by")])
    return once.where("cells = 1").select("part", "ax", "ay", "bx", "by")
