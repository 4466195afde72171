"""NetCDF grids, where the netCDF4 package is installed.

The file is read in bands of rows, one task each, from a path that all executors can open; levels and times but the
first are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.header import ARRANGEMENTS, Header, header_of


def variables(arrangement: str) -> tuple[str, str, str]:
    """Names of longitude, latitude and mask; W points take those of T."""
    if arrangement not in ARRANGEMENTS:
        raise ValueError(f"arrangement {arrangement!r} is none of {', '.join(ARRANGEMENTS)}")
    p = "t" if arrangement == "W" else arrangement.lower()
    return f"glam{p}", f"gphi{p}", f"{p}mask"


def read_netcdf(spark: SparkSession, path: str, name: str, arrangement: str, bands: int = 64) -> tuple[Header, DataFrame]:
    """The derived header and points (n, lon, lat, water)."""
    import netCDF4

    names = variables(arrangement)
    with netCDF4.Dataset(path) as f:
        ni, nj = len(f.dimensions["x"]), len(f.dimensions["y"])
    h = header_of(name, ni, nj, arrangement)

    def read(batches):
        import netCDF4

        for pdf in batches:
            for low, high in zip(pdf["low"], pdf["high"], strict=True):
                with netCDF4.Dataset(path) as f:
                    lon, lat, mask = (f.variables[v][(0,) * (f.variables[v].ndim - 2)][low:high].reshape(-1) for v in names)
                yield pd.DataFrame({"n": range(low * ni, high * ni), "lon": lon, "lat": lat, "water": mask != 0})

    step = -(-nj // bands)
    cut = spark.range(0, nj, step, -(-nj // step)).select(F.col("id").alias("low"), F.least(F.col("id") + step, F.lit(nj)).alias("high"))
    return h, cut.mapInPandas(read, "n bigint, lon double, lat double, water boolean")
