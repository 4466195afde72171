"""Tracks over a folded grid: positions after each of many moves, and what crosses between parts.

A track's position is its start and the sum of its moves so far, on the plane that the folded grid is unrolled to, taken
back into the grid at the end. The sums are made in two levels: moves are summed per track and slice of time, these sums
are added up in order of the slices, and moves are added up inside a slice. So a track of very many moves is spread over
its slices, and no task holds all of it.

Defined results: moves at the same time go by id; a move without a step stands still; a null step counts as none; moves
without a track, an id or a time are left out; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import core_periodic
from .header import Header

SLICE_SECONDS = 3600


def unrolled(x, y, h: Header):
    """Core i and j of a place on the unrolled plane, however far it is beyond the poles or the seam."""
    return core_periodic(x, F.pmod(y, F.lit(2 * (h.ny - 1))), h)


def sums_before(moves: DataFrame, seconds: int = SLICE_SECONDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Moves (track, id, at, di, dj and the columns to keep) with x and y, the sums of the steps before each, and their slice of time."""
    own = moves.select("track", "id", "at", "di", "dj", *[c for c in moves.columns if c in keep]).where("track is not null and id is not null and at is not null")
    own = own.withColumns({"slice": F.floor(F.unix_micros(F.col("at").cast("timestamp")) / (seconds * 1_000_000)), **{c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in ("di", "dj")}})
    slices = own.groupBy("track", "slice").agg(F.sum("di").alias("sum_i"), F.sum("dj").alias("sum_j"))
    earlier = Window.partitionBy("track").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    upto = lambda c, by: F.coalesce(F.sum(c).over(by), F.lit(0))
    bases = slices.select("track", "slice", upto("sum_i", earlier).alias("base_i"), upto("sum_j", earlier).alias("base_j"))
    inside = Window.partitionBy("track", "slice").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    within = own.withColumns({"in_i": upto("di", inside), "in_j": upto("dj", inside)})
    out = within.join(bases, ["track", "slice"])
    return out.withColumns({"x": F.col("base_i") + F.col("in_i"), "y": F.col("base_j") + F.col("in_j")}).drop("base_i", "base_j", "in_i", "in_j")


def positions(moves: DataFrame, start_i, start_j, h: Header, seconds: int = SLICE_SECONDS) -> DataFrame:
    """(track, id, at, from_i, from_j, to_i, to_j): core points before and after each move; starts are expressions on the moves."""
    own = sums_before(moves.withColumns({"start_i": start_i, "start_j": start_j}), seconds, ("start_i", "start_j"))
    x, y = F.col("start_i") + F.col("x"), F.col("start_j") + F.col("y")
    before, after = unrolled(x, y, h), unrolled(x + F.col("di"), y + F.col("dj"), h)
    return own.select("track", "id", "at", *[c.alias(n) for c, n in zip((*before, *after), ("from_i", "from_j", "to_i", "to_j"), strict=True)])


def crossings(tracks: DataFrame, from_part, to_part) -> DataFrame:
    """(from_part, to_part, moves, tracks) over positions; parts are expressions on them. Tracks are counted by first merging
    the moves of each track."""
    own = tracks.groupBy(from_part.alias("from_part"), to_part.alias("to_part"), "track").agg(F.count(F.lit(1)).alias("moves"))
    return own.groupBy("from_part", "to_part").agg(F.sum("moves").alias("moves"), F.count(F.lit(1)).alias("tracks"))
