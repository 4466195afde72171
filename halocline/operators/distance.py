"""Distance from every point of a grid to the nearest marked one, in steps of the grid (the larger of both directions).

The distance is the least over rows of max(rows away, columns away of the row's nearest marked point), so it is found in
two passes, with the columns of the grid closed into a ring and its rows continued beyond the fold:

* Along each row, windows carry the nearest marked column from either side, in time linear in the points for any reach.
* Each column, with the `most` rows that follow beyond the fold, takes the least of max(rows away, the row's distance).
  Whether some row within k has a distance of k or less only changes once as k grows, so k is found by halving, for a
  whole column at once, over least values of runs of 1, 2, 4, ... rows.

Defined results: distances are 0 at marked points, and `most` where nothing is nearer; marks count at their owner and all its
ghosts; without marks all points have `most`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fold import shift_once
from .header import Header
from .points import spine, with_master

FAR = 1 << 28


def along_rows(points: DataFrame, nx: int) -> DataFrame:
    """Points (i, j, marked) with `r`, columns away from the nearest marked point of the row, whose ends meet."""
    row = Window.partitionBy("j")
    at = F.when(F.col("marked"), F.col("i"))
    # Both windows grow from their start: one that shrinks towards its end would be gone through again for every row.
    last = lambda order: F.last(at, ignorenulls=True).over(row.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    before, behind = last(F.asc("i")), last(F.desc("i"))
    ends = F.max(at).over(row) - nx, F.min(at).over(row) + nx
    r = F.least(F.col("i") - F.coalesce(before, ends[0]), F.coalesce(behind, ends[1]) - F.col("i"))
    return points.withColumn("r", F.coalesce(r, F.lit(FAR)).cast("int"))


def least_within(r: np.ndarray, most: int) -> np.ndarray:
    """For each place of a column, the least of max(rows away, r) up to `most`."""
    runs = [np.minimum(r, most)]  # least of runs of 2 ** k rows that start here
    while 2 << (len(runs) - 1) <= min(len(r), 2 * most + 1):
        half = 1 << (len(runs) - 1)
        runs.append(np.minimum(runs[-1][:-half], runs[-1][half:]))
    place = np.arange(len(r))

    def reached(k: np.ndarray) -> np.ndarray:
        a, b = np.maximum(place - k, 0), np.minimum(place + k, len(r) - 1)
        power = np.frexp(b - a + 1)[1] - 1
        least = np.empty(len(r), r.dtype)
        for p in np.unique(power):
            some = power == p
            least[some] = np.minimum(runs[p][a[some]], runs[p][b[some] - (1 << p) + 1])
        return least <= k

    low, high = np.zeros(len(r), np.int64), np.full(len(r), most, np.int64)  # high is reached, or `most`
    while (low < high).any():
        middle = (low + high) // 2
        hit = reached(middle)
        high, low = np.where(hit, middle, high), np.where(hit, low, np.minimum(middle + 1, high))
    return high


def down_columns(rows: DataFrame, top: int, most: int) -> DataFrame:
    """(i, j, d) of rows (i, j, r) with j up to `top`; columns stream past in order, one at a time."""

    def run(batches):
        held = [np.empty(0, np.int64) for _ in range(3)]
        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy().astype(np.int64)]) for k, h in enumerate(held)]
            starts = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]]) if len(held[0]) else []
            end = int(starts[-1]) if len(starts) else 0
            if end:
                yield from of_columns([h[:end] for h in held])
                held = [h[end:] for h in held]
        if len(held[0]):
            yield from of_columns(held)

    def of_columns(table):
        i, j, r = table
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(i)], strict=True):
            d = least_within(r[a:b], most)
            own = j[a:b] <= top
            yield pa.RecordBatch.from_arrays([pa.array(x[own].astype(np.int32)) for x in (i[a:b], j[a:b], d)], ["i", "j", "d"])

    return rows.select("i", "j", "r").repartition("i").sortWithinPartitions("i", "j").mapInArrow(run, "i int, j int, d int")


def to_marked(spark: SparkSession, marks: DataFrame, h: Header, most: int) -> DataFrame:
    """(n, d) of every owner point above the south halo: its distance to the nearest point of `marks` (n_master)."""
    top = int(h.pivot_j)  # the last row before the fold, or on it
    area = with_master(spine(spark, h), h).where(F.col("ih").between(h.halo_w, h.halo_w + h.nx - 1) & F.col("jh").between(h.halo_s, top))
    marked = marks.select("n_master").distinct().withColumn("marked", F.lit(True))
    seen = area.join(marked, "n_master", "left").select(F.col("ih").alias("i"), F.col("jh").alias("j"), F.coalesce("marked", F.lit(False)).alias("marked"))
    rows = along_rows(seen, h.nx)
    beyond = rows.select(shift_once(F.lit(int(2 * h.pivot_i)) - F.col("i"), h).cast("int").alias("i"), (F.lit(int(2 * h.pivot_j)) - F.col("j")).alias("j"), "r")
    both = rows.select("i", "j", "r").unionByName(beyond.where(F.col("j").between(top + 1, top + most)))
    found = down_columns(both, top, most)
    n = F.col("j").cast("bigint") * h.ni + F.col("i")
    own = with_master(found.select(F.col("i").alias("ih"), F.col("j").alias("jh"), n.alias("n"), "d"), h)
    return own.where("n = n_master").select("n", "d")
