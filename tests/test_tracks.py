"""Tracks on a folded grid against single steps in order, and their plan."""

import datetime
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from halocline.operators import tracks
from halocline.operators.header import Header

TINY = Header("tiny", 10, 8, 1, 1, 1, 1, 5.0, 6.0)
MOVES = "track bigint, id bigint, at timestamp, di int, dj int"


class Walker:
    """Walks point by point. Beyond a pole's row it comes down on the other side, half a turn away, until it is on a pole's row again."""

    def __init__(self, i, j, h):
        self.i, self.j, self.away, self.h = i, j, False, h

    def step(self, di, dj):
        for _ in range(abs(dj)):
            j = self.j + (1 if dj > 0 else -1) * (-1 if self.away else 1)
            if not 0 <= j < self.h.ny:  # off a pole's row, on the other side
                self.away, self.i, j = True, self.i + self.h.nx // 2, 2 * self.j - j
            elif self.away and j in (0, self.h.ny - 1):
                self.away, self.i = False, self.i - self.h.nx // 2
            self.j = j
        self.i = (self.i + di) % self.h.nx


def plain(moves, start, h):
    """(track, id) -> points before and after, of moves without nulls."""
    out, walkers = {}, {}
    for track, i, at, di, dj in sorted(moves, key=lambda m: (m[0], m[2], m[1])):
        w = walkers.setdefault(track, Walker(*start(track), h))
        before = (w.i % h.nx, w.j)
        w.step(di or 0, dj or 0)
        out[track, i] = (*before, w.i % h.nx, w.j)
    return out


@pytest.mark.parametrize("seconds", [1, 60, 86400])
def test_positions_match_single_steps(spark, seconds):
    rng, t0 = random.Random(seconds), datetime.datetime(2020, 1, 1)
    # One track holds a third of the moves, many at the same time.
    moves = [(0 if rng.random() < 0.33 else rng.randrange(1, 9), k, t0 + datetime.timedelta(seconds=rng.randrange(200)), rng.randrange(-25, 26), rng.choice([None, *range(-40, 41)])) for k in range(600)]
    df = spark.createDataFrame(moves, MOVES)
    got = tracks.positions(df, F.col("track") % TINY.nx, F.col("track") % TINY.ny, TINY, seconds)
    found = {(r.track, r.id): (r.from_i, r.from_j, r.to_i, r.to_j) for r in got.collect()}
    assert found == plain(moves, lambda t: (t % TINY.nx, t % TINY.ny), TINY)
    assert any(b[1] == TINY.ny - 1 for b in found.values()) and any(b[1] == 0 for b in found.values())


def test_crossings_count_moves_and_tracks(spark):
    at = datetime.datetime(2020, 1, 1)
    moves = [(t, 10 * t + k, at + datetime.timedelta(seconds=k), 5, 0) for t in (1, 2) for k in range(4)]
    found = tracks.positions(spark.createDataFrame(moves, MOVES), F.lit(0), F.lit(3), TINY)
    half = lambda c: F.floor(F.col(c) * 2 / TINY.nx).cast("int")
    got = {tuple(r) for r in tracks.crossings(found, half("from_i"), half("to_i")).collect()}
    ways = defaultdict(set)
    for (t, i), (fi, _, ti, _) in plain(moves, lambda t: (0, 3), TINY).items():
        ways[fi * 2 // TINY.nx, ti * 2 // TINY.nx].add((t, i))
    assert got == {(*k, len(v), len({t for t, _ in v})) for k, v in ways.items()}


def test_nulls_and_empty_tables(spark):
    at = datetime.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, 1, at, None, None), (None, 2, at, 1, 1), (1, None, at, 1, 1), (1, 3, None, 1, 1), (1, 4, at, 2, 0)], MOVES)
    got = tracks.positions(df.withColumns({c: F.lit("own") for c in ("slice", "x", "in_i", "base_j", "sum_i")}), F.lit(1), F.lit(1), TINY)
    assert sorted((r.id, r.from_i, r.to_i) for r in got.collect()) == [(1, 1, 1), (4, 1, 3)]
    assert tracks.positions(df.limit(0), F.lit(1), F.lit(1), TINY).count() == 0


def test_slices_are_summed_before_they_meet(spark):
    df = spark.createDataFrame([(1, 1, datetime.datetime(2020, 1, 1), 1, 1)], MOVES)
    plan = tracks.positions(df, F.lit(0), F.lit(0), TINY)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
