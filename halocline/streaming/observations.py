"""Windowed counts and sums of a stream of observations on the owners of the grid points that they hash to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import master
from ..operators.header import Header


def windowed_on_points(stream: DataFrame, key: Column, value: Column, h: Header, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, n_master, observations, cents); rows later than `late` are dropped and closed windows leave the state."""
    n = F.pmod(key.cast("bigint"), F.lit(h.size))
    m = master((n % h.ni).cast("int"), F.floor(n / h.ni).cast("int"), h)
    owner = (m["j"].cast("bigint") * h.ni + m["i"]).alias("n_master")
    cents = F.sum(F.round(value * 100).cast("bigint")).alias("cents")
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("window"), owner).agg(F.count(F.lit(1)).alias("observations"), cents)
