"""Halo consistency and element quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .header import Header


def halo_repaired(points: DataFrame) -> DataFrame:
    """Every point with its master's coordinates and mask (n, n_master, lon, lat, water), and whether they differed.

    Masters of masters are themselves, so one equi-join does it whatever the order.
    """
    away = points.where("n <> n_master").select("n", "n_master", "lon", "lat", "water")
    own = points.select(F.col("n").alias("m"), F.col("lon").alias("m_lon"), F.col("lat").alias("m_lat"), F.col("water").alias("m_water"))
    both = away.join(own, F.col("n_master") == F.col("m"))  # few points, so that this side is broadcast where it is small
    moved = g.sphere_distance((F.col("lon"), F.col("lat")), (F.col("m_lon"), F.col("m_lat")))
    fixed = both.select(
        "n",
        "n_master",
        F.col("m_lon").alias("lon"),
        F.col("m_lat").alias("lat"),
        F.col("m_water").alias("water"),
        (F.col("water") != F.col("m_water")).alias("mask_differs"),
        ((F.col("lon") != F.col("m_lon")) | (F.col("lat") != F.col("m_lat"))).alias("coordinates_differ"),
        moved.alias("metres"),
    )
    never = F.lit(False)
    rest = points.where("n = n_master").select("n", "n_master", "lon", "lat", "water", never.alias("mask_differs"), never.alias("coordinates_differ"), F.lit(0.0).alias("metres"))
    return rest.unionByName(fixed)


CORNERS = ("sw", "se", "ne", "nw")


def cell_corners(points: DataFrame, h: Header) -> DataFrame:
    """Cells (ih, jh of the south-western point) with the coordinates and masks of their four corners.

    Each point is dealt to the cells it is a corner of, then cells are put together: one shuffle.
    """
    place = F.array(*[F.struct((F.col("ih") - di).alias("ih"), (F.col("jh") - dj).alias("jh"), F.lit(k).alias("k")) for k, (di, dj) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    dealt = points.select(F.explode(place).alias("c"), "lon", "lat", "water").where(F.col("c.ih").between(0, h.ni - 2) & F.col("c.jh").between(0, h.nj - 2))
    own = lambda k, col: F.max(F.when(F.col("c.k") == k, F.col(col)))
    return dealt.groupBy(F.col("c.ih").alias("ih"), F.col("c.jh").alias("jh")).agg(*[own(k, col).alias(f"{col}_{name}") for k, name in enumerate(CORNERS) for col in ("lon", "lat", "water")])


def classified(cells: DataFrame, h: Header, diagonal_factor: float = 2.5, with_3d: bool = True) -> DataFrame:
    """Cells with `element_class` (first rule that holds: quad2d, diagonal, quad3d, two_degree, else ok), has_water and flagged.

    A cell with water is flagged only if its diagonal exceeds ten times the resolution. The statistics count classes
    before that exemption.
    """
    west = F.col("lon_sw") - 180.0
    lon = {c: F.col("lon_sw") if c == "sw" else g.normalised(F.col(f"lon_{c}"), west) for c in CORNERS}
    cells = cells.withColumns({f"x_{c}": lon[c] for c in CORNERS})
    p = [(F.col(f"x_{c}"), F.col(f"lat_{c}")) for c in CORNERS]
    lat_max = F.greatest(*[y for _, y in p])
    lon_min = g.normalised(F.least(*[x for x, _ in p]), F.lit(-180.0))
    dlon_n, dlon_s = p[2][0] - p[3][0], p[1][0] - p[0][0]
    uneven = (lat_max < 60) & (lon_min > -20) & (lon_min < 20) & (F.greatest(dlon_n, dlon_s) > 2 * F.least(dlon_n, dlon_s))
    kind = F.when(g.invalid_quad_2d(*p) & (lat_max < 45), "quad2d").when((lat_max < 60) & g.diagonal_too_large(*p, h.resolution * diagonal_factor), "diagonal")
    if with_3d:
        kind = kind.when(g.invalid_quad_3d(*p), "quad3d")
    if abs(h.resolution - 2) < 0.1:
        kind = kind.when(uneven, "two_degree")
    water = F.col("water_sw") | F.col("water_se") | F.col("water_ne") | F.col("water_nw")
    out = cells.select("ih", "jh", kind.otherwise("ok").alias("element_class"), water.alias("has_water"), g.diagonal_too_large(*p, h.resolution * 10).alias("huge"))
    return out.select("ih", "jh", "element_class", "has_water", ((F.col("element_class") != "ok") & (~F.col("has_water") | F.col("huge"))).alias("flagged"))


def statistics(cells: DataFrame) -> DataFrame:
    """One row of counters over classified cells."""
    of = lambda k: F.count_if(F.col("element_class") == k)
    return cells.agg(F.count_if(F.col("element_class") != "ok").alias("invalid_elements"), of("quad2d").alias("invalid_quads_2d"), of("quad3d").alias("invalid_quads_3d"), of("diagonal").alias("diagonal_too_large"), F.count_if("flagged").alias("flagged"), F.count_if(~F.col("has_water")).alias("dry"))
