"""Index maps of a north-folded grid as Column expressions.

Two frames are kept apart: the halo frame (ih, jh) counts from the most south-western halo point, the core frame (i, j)
from the first interior one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.header import Header


def _int(c: Column) -> Column:
    return c.cast("int")


def shift_once(i: Column, h: Header) -> Column:
    """One period towards the interior columns; what lies further out stays out."""
    return i + F.when(i < h.halo_w, h.nx).when(i >= h.halo_w + h.nx, -h.nx).otherwise(0)


def master(ih: Column, jh: Column, h: Header) -> Column:
    """struct<i, j> (halo frame) of the point that owns (ih, jh): wrap, then reflect at the pivot and wrap once more."""
    i = shift_once(ih, h)
    beyond = (jh > h.pivot_j) | ((jh == h.pivot_j) & (i > h.pivot_i))
    folded = F.when(beyond, F.lit(int(2 * h.pivot_i)) - i).otherwise(i)
    return F.struct(_int(F.when(beyond, shift_once(folded, h)).otherwise(i)).alias("i"), _int(F.when(beyond, F.lit(int(2 * h.pivot_j)) - jh).otherwise(jh)).alias("j"))


def linear(i: Column, j: Column, h: Header) -> Column:
    """Linear index of core (i, j), with the halo, i fastest."""
    return ((i + h.halo_w) + (j + h.halo_s).cast("bigint") * h.ni).cast("bigint")


def core_of_linear(n: Column, h: Header) -> tuple[Column, Column]:
    """Core i and j of a linear index."""
    return _int(_mod(n, h.ni) - h.halo_w), _int(_div(n, h.ni) - h.halo_s)


def periodic(i: Column, j: Column, h: Header) -> tuple[Column, Column]:
    """Core i and j of the owner of core (i, j)."""
    m = master(i + h.halo_w, j + h.halo_s, h)
    return m["i"] - h.halo_w, m["j"] - h.halo_s


def wrap(v: Column, lower: int, upper: int) -> Column:
    """v modulo the width, in [lower, upper)."""
    return F.lit(lower) + F.coalesce(F.pmod(v - lower, F.lit(upper - lower)), F.lit(0))


def core_periodic(i: Column, j: Column, h: Header) -> tuple[Column, Column]:
    """The map on the core rectangle alone: mirror and half a turn at both poles, then wrap i."""
    top = h.ny - 1
    over = j > top
    # A row mirrored at the north may come out below the south and is mirrored again.
    j1 = F.when(over, 2 * top - j).otherwise(j)
    i1 = i + F.when(over, h.nx // 2).otherwise(0) + F.when(j1 < 0, h.nx // 2).otherwise(0)
    return _int(wrap(i1, 0, h.nx)), _int(F.when(j1 < 0, -j1).otherwise(j1))


def outside_halo(i: Column, j: Column, h: Header) -> Column:
    """Beyond the grid's own halo on the west, east or north."""
    return (i >= h.nx + h.halo_e) | (j >= h.ny + h.halo_n) | (i < -h.halo_w)


def haloed(i: Column, j: Column, h: Header) -> tuple[Column, Column]:
    """Core (i, j), taken to its owner only where it lies beyond the grid's own halo."""
    pi, pj = periodic(i, j, h)
    out = outside_halo(i, j, h)
    return _int(F.when(out, pi).otherwise(i)), _int(F.when(out, pj).otherwise(j))


def is_ghost(ih: Column, jh: Column, h: Header) -> Column:
    m = master(ih, jh, h)
    return (jh < h.halo_s) | (m["i"] != ih) | (m["j"] != jh)


def in_own_halo(i: Column, j: Column, h: Header) -> Column:
    return ((i < 0) & (i >= -h.halo_w)) | ((i >= h.nx) & (i < h.nx + h.halo_e)) | ((j < 0) & (j >= -h.halo_s)) | ((j >= h.ny) & (j < h.ny + h.halo_n))


def clamp(v: Column, lower: int, upper: int) -> Column:
    return F.greatest(F.lit(lower), F.least(v, F.lit(upper)))


def checkerboard(core: DataFrame, h: Header, parts: int, bands: int | None = None) -> DataFrame:
    """Core points (n, ix, iy) with the part of the checkerboard that owns them, in closed form instead of by ranking.

    The points in row-major order are cut into equal bands, the points of a band in column-major order into equal
    parts; where numbers don't divide, the first ones get one more. Columns are made in steps, each used several times
    by the next, so that the plan keeps them apart and evaluates each once.
    """
    bands = bands or default_bands(parts)
    size, each, nx = h.nx * h.ny, parts // bands, h.nx
    q, r = size // bands, size % bands
    i, j = F.col("ix"), F.col("iy")
    start = lambda b: b * q + F.least(b, F.lit(r))
    before = lambda x: _div(x, nx) * i + F.least(_mod(x, nx), i)  # noqa: E731  points of columns under i among the first x
    out = core.withColumn("band", bucket(F.col("n"), F.lit(size), bands))
    out = out.withColumns({"s": start(F.col("band")), "e": start(F.col("band") + 1)})
    out = out.withColumn("rank", before(F.col("e")) - before(F.col("s")) + j + _div(i - F.col("s"), nx))  # less the column's first row
    out = out.withColumn("q", _div(F.col("e") - F.col("s"), each)).withColumn("r", F.col("e") - F.col("s") - F.col("q") * each)
    low = F.col("rank") < F.col("r") * (F.col("q") + 1)
    at = F.when(low, _div(F.col("rank"), F.col("q") + 1)).otherwise(F.col("r") + _div(F.col("rank") - F.col("r") * (F.col("q") + 1), F.greatest(F.col("q"), F.lit(1))))
    return out.withColumn("part", (F.col("band") * each + at).cast("int")).select(*core.columns, "part")


def regular_checkerboard(core: DataFrame, h: Header, parts: int, bands: int | None = None) -> DataFrame:
    """Core points with the part that owns them, all parts being rectangles: bands of whole rows, cut at the same columns."""
    bands = bands or default_bands(parts)
    each = parts // bands
    band, place = bucket(F.col("iy"), F.lit(h.ny), bands), bucket(F.col("ix"), F.lit(h.nx), each)
    return core.withColumn("part", (band * each + place).cast("int"))


def _div(a: Column, b) -> Column:
    """Whole division downwards; never null, so that joins on it need no null filters."""
    return F.coalesce(F.floor(a / b), F.lit(0)).cast("bigint")


def _mod(a: Column, b) -> Column:
    return F.coalesce(a % b, F.lit(0))


def bucket(rank: Column, size: Column, k: int) -> Column:
    """0-based number of the bucket of `rank` when `size` ranks are cut into k, the first ones longer by one."""
    q, r = _div(size, k), _mod(size, k)
    return F.when(rank < r * (q + 1), _div(rank, q + 1)).otherwise(r + _div(rank - r * (q + 1), F.greatest(q, F.lit(1)))).cast("bigint")


def default_bands(parts: int) -> int:
    """Bands for a number of parts: the largest divisor not above its square root."""
    return max(b for b in range(1, int(parts**0.5) + 1) if parts % b == 0)


FLAG_BITS = {"ghost": 0, "water": 1, "invalid": 2}


def flag_byte(**flags: Column) -> Column:
    out = F.lit(0)
    for name, value in flags.items():
        out = out.bitwiseOR(F.when(value, F.lit(1 << FLAG_BITS[name])).otherwise(F.lit(0)))
    return out.cast("int")


def flag_set(byte: Column, name: str) -> Column:
    return byte.bitwiseAND(F.lit(1 << FLAG_BITS[name])) != 0


def with_flag(byte: Column, name: str) -> Column:
    return byte.bitwiseOR(F.lit(1 << FLAG_BITS[name]))


def without_flag(byte: Column, name: str) -> Column:
    return byte.bitwiseAND(F.lit(0xFF ^ (1 << FLAG_BITS[name])))
