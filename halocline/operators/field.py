"""Observations on grid points and fields on nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import master
from .header import Header


def on_points(rows: DataFrame, key: Column, h: Header, *measures: Column) -> DataFrame:
    """Rows aggregated at the owners of the grid points that an integer key hashes to.

    Combined by key before any shuffle; the owner is computed from the key, so there is no join with the grid.
    """
    n = F.pmod(key.cast("bigint"), F.lit(h.size))
    m = master((n % h.ni).cast("int"), F.floor(n / h.ni).cast("int"), h)
    return rows.groupBy((m["j"].cast("bigint") * h.ni + m["i"]).alias("n_master")).agg(*measures)


def to_ghosts(values: DataFrame, points: DataFrame) -> DataFrame:
    """Halo exchange on the grid: each point that isn't its own master receives its master's values."""
    return points.where(F.col("n") != F.col("n_master")).select("n", "n_master").join(values, "n_master")


def error_norm(field: DataFrame, value: str = "value", expected: str = "expected", tolerance: float = 1e-6) -> DataFrame:
    """One row: L2 norm of the difference and how many values are off by more than the tolerance."""
    d = F.col(value) - F.col(expected)
    return field.agg(F.sqrt(F.sum(d * d)).alias("l2"), F.count_if(F.abs(d) > tolerance).alias("mismatches"))
