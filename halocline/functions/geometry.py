"""Longitudes, quadrilaterals and the sphere as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371229.0  # metres, a sphere
Corner = tuple[Column, Column]  # longitude, latitude


def normalised(lon: Column, west: Column) -> Column:
    """Longitude in [west, west + 360)."""
    return lon - F.floor((lon - west) / 360.0) * 360.0


def sphere_xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Unit vector."""
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def sphere_distance(a: Corner, b: Corner) -> Column:
    """Great-circle metres (haversine)."""
    h = F.pow(F.sin(F.radians(b[1] - a[1]) / 2), 2) + F.cos(F.radians(a[1])) * F.cos(F.radians(b[1])) * F.pow(F.sin(F.radians(b[0] - a[0]) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def invalid_quad_2d(sw: Corner, se: Corner, ne: Corner, nw: Corner) -> Column:
    """A side runs backwards in longitude or latitude."""
    t = -1e-10
    return (nw[1] - sw[1] < t) | (ne[1] - se[1] < t) | (ne[0] - nw[0] < t) | (se[0] - sw[0] < t)


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def invalid_quad_3d(sw: Corner, se: Corner, ne: Corner, nw: Corner) -> Column:
    """On the sphere, the normals at the four corners don't all point to one side: concave or folded.

    A definition of our own: each pair of corner normals must have a scalar product of at least zero (within 1e-12).
    """
    p = [sphere_xyz(*c) for c in (sw, se, ne, nw)]
    minus = lambda a, b: tuple(x - y for x, y in zip(a, b, strict=True))
    normals = [_cross(minus(p[(k + 1) % 4], p[k]), minus(p[(k - 1) % 4], p[k])) for k in range(4)]
    bad = F.lit(False)
    for a in range(4):
        for b in range(a + 1, 4):
            bad = bad | (sum(x * y for x, y in zip(normals[a], normals[b], strict=True)) < -1e-12)
    return bad


def diagonal_too_large(sw: Corner, se: Corner, ne: Corner, nw: Corner, limit: float) -> Column:
    """The longer diagonal in degrees exceeds the limit; a limit of 0 switches the test off."""
    if not limit:
        return F.lit(False)
    square = lambda a, b: (b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1])
    return F.greatest(square(sw, ne), square(nw, se)) > limit * limit
