"""Grid headers: dimensions, halo and pivot, and their derivation from the arrangement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARRANGEMENTS = ("F", "T", "U", "V", "W")


@dataclass(frozen=True)
class Header:
    """Halo widths count points, the pivot is in the halo frame and may be half-integral."""

    grid: str
    ni: int
    nj: int
    halo_n: int
    halo_w: int
    halo_s: int
    halo_e: int
    pivot_i: float
    pivot_j: float

    @property
    def nx(self) -> int:
        return self.ni - self.halo_w - self.halo_e

    @property
    def ny(self) -> int:
        return self.nj - self.halo_s - self.halo_n

    @property
    def size(self) -> int:
        return self.ni * self.nj

    @property
    def resolution(self) -> float:
        return 360.0 / self.nx

    def check(self) -> Header:
        if min(self.ni, self.nj) <= 0 or min(self.halo_n, self.halo_w, self.halo_s, self.halo_e, self.pivot_i, self.pivot_j) < 0:
            raise ValueError(f"{self.grid}: dimensions, halo and pivot must be given and not negative")
        return self


#: (halo north, halo south, pivot offset i, pivot offset j); the family of 1 degree grids folds at an F point.
T_FOLD = {"T": (1, 1, 0.0, 0.0), "W": (1, 1, 0.0, 0.0), "U": (1, 1, -0.5, 0.0), "V": (2, 1, 0.0, -0.5), "F": (2, 0, -0.5, -0.5)}
F_FOLD = {"T": (1, 1, 0.5, 0.5), "W": (1, 1, 0.5, 0.5), "U": (1, 1, 0.0, 0.5), "V": (1, 1, 0.5, 0.0), "F": (1, 0, 0.0, 0.0)}


def header_of(grid: str, ni: int, nj: int, arrangement: str) -> Header:
    """The header of a grid of ni x nj points with a halo of one on the west and east."""
    if arrangement not in ARRANGEMENTS:
        raise ValueError(f"arrangement {arrangement!r} is none of {', '.join(ARRANGEMENTS)}")
    f_fold = ni - 2 == 360
    n, s, di, dj = (F_FOLD if f_fold else T_FOLD)[arrangement]
    return Header(grid, ni, nj, n, 1, s, 1, ni // 2 - f_fold + di, nj - 2 + dj).check()


def derive_headers(specs: DataFrame) -> DataFrame:
    """The same for a table of specs (grid, ni, nj, arrangement), with the sizes that follow."""
    f_fold = F.col("ni") - 2 == 360

    def choice(k: int):
        out = F.lit(None)
        for a in ARRANGEMENTS:
            out = F.when(F.col("arrangement") == a, F.when(f_fold, F.lit(F_FOLD[a][k])).otherwise(F.lit(T_FOLD[a][k]))).otherwise(out)
        return out

    h = specs.where(F.col("arrangement").isin(*ARRANGEMENTS)).select(
        "grid",
        "arrangement",
        "ni",
        "nj",
        choice(0).cast("int").alias("halo_n"),
        F.lit(1).alias("halo_w"),
        choice(1).cast("int").alias("halo_s"),
        F.lit(1).alias("halo_e"),
        (F.floor(F.col("ni") / 2) - f_fold.cast("int") + choice(2)).cast("double").alias("pivot_i"),
        (F.col("nj") - 2 + choice(3)).cast("double").alias("pivot_j"),
    )
    size = F.col("ni").cast("bigint") * F.col("nj")
    return h.withColumns(
        {
            "nx": F.col("ni") - F.col("halo_w") - F.col("halo_e"),
            "ny": F.col("nj") - F.col("halo_s") - F.col("halo_n"),
            "size": size,
            # Two doubles a point and two bit vectors; the invalid flags are not counted.
            "footprint": (size * 16 + F.floor(size / 8) * 2).cast("bigint"),
        }
    )
