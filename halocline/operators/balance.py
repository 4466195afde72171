"""Parts of equal load: a checkerboard cut by what happens at the points instead of by their number.

Points in row-major order are cut into bands of equal load, the points of a band in column-major order into parts of
equal load. Where a point falls follows from the load before it, so it takes two prefix sums. Each is a sum over whole rows (or a
band's columns) before, plus one inside the own row (or column): windows hold a row of the grid or a load per row, never the grid.

A part's load differs from the mean by at most two points' loads. Defined results: points without load count `base`; with a
base of 0 and no load at all, all points are in part 0; loads are whole and not negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fold import default_bands
from .header import Header


def before(points: DataFrame, group: list[str], major: str, minor: str, load: str) -> DataFrame:
    """`points` with `prefix` (load of the group's points before, by major and then minor) and `total` (the group's)."""
    sums = points.groupBy(*group, major).agg(F.sum(load).alias("line"))
    whole = Window.partitionBy(*group)
    upto = F.coalesce(F.sum("line").over(whole.orderBy(major).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = sums.select(*group, major, upto.alias("lines"), F.sum("line").over(whole).alias("total"))
    inside = F.coalesce(F.sum(load).over(Window.partitionBy(*group, major).orderBy(minor).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return points.withColumn("inside", inside).join(lines, [*group, major]).withColumn("prefix", F.col("lines") + F.col("inside")).drop("lines", "inside")


def owners_by_load(spark: SparkSession, load: DataFrame, h: Header, parts: int, bands: int | None = None, base: int = 0) -> DataFrame:
    """(n, ix, iy, load, part) of every core point; load: (ix, iy, load), added up where points repeat."""
    bands = bands or default_bands(parts)
    if parts < 1 or parts % bands:
        raise ValueError("parts must be positive and a multiple of the bands")
    n = F.col("id")
    given = load.groupBy("ix", "iy").agg(F.sum("load").cast("bigint").alias("given"))
    core = spark.range(h.nx * h.ny).select(n.alias("n"), (n % h.nx).cast("int").alias("ix"), F.floor(n / h.nx).cast("int").alias("iy"))
    points = core.join(given, ["ix", "iy"], "left").select("n", "ix", "iy", (F.coalesce("given", F.lit(0)) + base).alias("load"))
    cut = lambda k: F.coalesce(F.expr(f"prefix * {k} div nullif(total, 0)"), F.lit(0))
    last = lambda k: F.least(cut(k), F.lit(k - 1))  # noqa: E731  points without load behind the last that has some
    banded = before(points.withColumn("all", F.lit(0)), ["all"], "iy", "ix", "load").select("n", "ix", "iy", "load", last(bands).cast("int").alias("band"))
    each = parts // bands
    return before(banded, ["band"], "ix", "iy", "load").select("n", "ix", "iy", "load", (F.col("band") * each + last(each)).cast("int").alias("part"))


def summary(owned: DataFrame) -> DataFrame:
    """(part, points, load, ix_min, ix_max, iy_min, iy_max) of every part."""
    bounds = [f(c).alias(f"{c}_{name}") for c in ("ix", "iy") for name, f in (("min", F.min), ("max", F.max))]
    return owned.groupBy("part").agg(F.count(F.lit(1)).alias("points"), F.sum("load").alias("load"), *bounds)
