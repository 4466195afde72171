"""Repeated halo exchange: a field that stays in blocks while only the values along their edges move.

The core rectangle is cut into blocks of whole rows and columns. A block is one row of a table that is bucketed by block,
so that it is read, joined and written in the same place in every step. Which values a block needs from others, its ring, is
known from the index maps alone (seam and fold): for each block that owns some of them, a row lists who asks for which place. In a
step each block picks what others ask of it; those few values are the only rows that are shuffled.

`smoothed` takes (4 v + west + east + south + north) / 8 in whole numbers, rounded down; beyond the south edge, where there
is no point, the point's own value stands in. Each step is a written table, so that a lost executor costs one step.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import periodic
from ..sources.shared import scratch_path
from .header import Header

BLOCK = "block int, x0 int, y0 int, width int, height int, values array<bigint>"
SIDES = ("west", "east", "south", "north")


class Blocks:
    """A cut of the core rectangle into bands by columns, and the tables of a field in it."""

    def __init__(self, spark: SparkSession, h: Header, bands: int, columns: int, buckets: int):
        if not 0 < bands <= h.ny or not 0 < columns <= h.nx:
            raise ValueError("a block needs a row and a column at least")
        self.spark, self.h, self.bands, self.columns, self.buckets = spark, h, bands, columns, buckets
        self.tables: list[str] = []

    def _at(self, v: Column, size: int, parts: int) -> tuple[Column, Column, Column]:
        """Number, first place and width of the slice that holds v, of `parts` equal slices (bounds rounded down)."""
        k = F.floor(((v + 1) * parts - 1) / size).cast("int")
        first = lambda b: F.floor(b * size / parts).cast("int")
        return k, first(k), first(k + 1) - first(k)

    def place(self, i: Column, j: Column) -> dict[str, Column]:
        """Block and place (row-major) of a core point, and the block's bounds."""
        bx, x0, width = self._at(i, self.h.nx, self.columns)
        by, y0, height = self._at(j, self.h.ny, self.bands)
        return {"block": by * self.columns + bx, "x0": x0, "y0": y0, "width": width, "height": height, "place": (j - y0) * width + i - x0}

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """A table bucketed by block, in the shared folder."""
        table = f"halocline_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "block").option("path", scratch_path(self.spark, name)).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self) -> None:
        """Forget the tables; the files go with the session."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def of_values(self, values: DataFrame) -> DataFrame:
        """Blocks of values (i, j, value) at core points, 0 where none is given."""
        p = self.place(F.col("i"), F.col("j"))
        rows = values.select(F.col("value").cast("bigint").alias("value"), *[c.cast("int").alias(k) for k, c in p.items()])
        every = self.spark.range(self.bands * self.columns).select((F.col("id") % self.columns).cast("int").alias("bx"), F.floor(F.col("id") / self.columns).cast("int").alias("by"))
        start = lambda k, size, parts: F.floor(k * size / parts).cast("int")
        x0, y0 = start(F.col("bx"), self.h.nx, self.columns), start(F.col("by"), self.h.ny, self.bands)
        empty = every.select(F.lit(None).cast("bigint").alias("value"), (F.col("by") * self.columns + F.col("bx")).cast("int").alias("block"), x0.alias("x0"), y0.alias("y0"), (start(F.col("bx") + 1, self.h.nx, self.columns) - x0).alias("width"), (start(F.col("by") + 1, self.h.ny, self.bands) - y0).alias("height"), F.lit(0).alias("place"))

        def packed(pdf):
            first = pdf.iloc[0]
            values = np.zeros(int(first["width"]) * int(first["height"]), np.int64)
            given = pdf[pdf["value"].notna()]
            np.add.at(values, given["place"].to_numpy(np.int64), given["value"].to_numpy(np.int64))
            return pdf.iloc[:1][["block", "x0", "y0", "width", "height"]].assign(values=[values])

        every_row = rows.unionByName(empty.select(*rows.columns))
        return self._kept(every_row.groupBy("block").applyInPandas(packed, BLOCK), "blocks")

    def asked(self) -> DataFrame:
        """(block, asks): for each block the places that others want of it: asks of (asking, side, at, place)."""
        h, all_blocks = self.h, self.spark.range(self.bands * self.columns)
        bx, by = (F.col("id") % self.columns).cast("int"), F.floor(F.col("id") / self.columns).cast("int")
        start = lambda k, size, parts: F.floor(k * size / parts).cast("int")
        x0, x1 = start(bx, h.nx, self.columns), start(bx + 1, h.nx, self.columns)
        y0, y1 = start(by, h.ny, self.bands), start(by + 1, h.ny, self.bands)
        span = lambda a, b, i, j: F.transform(F.sequence(F.lit(0), b - a - 1), lambda t: F.struct(t.alias("at"), i(t).cast("int").alias("i"), j(t).cast("int").alias("j")))
        ring = {"west": span(y0, y1, lambda t: x0 - 1, lambda t: y0 + t), "east": span(y0, y1, lambda t: x1, lambda t: y0 + t), "south": span(x0, x1, lambda t: x0 + t, lambda t: y0 - 1), "north": span(x0, x1, lambda t: x0 + t, lambda t: y1)}
        sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), ring[s].alias("points")) for k, s in enumerate(SIDES)]))
        points = all_blocks.select(F.col("id").cast("int").alias("asking"), sides.alias("s")).select("asking", "s.side", F.explode("s.points").alias("p")).select("asking", "side", "p.*")
        i, j = periodic(F.col("i"), F.col("j"), h)
        inside = F.col("i").between(0, h.nx - 1) & F.col("j").between(0, h.ny - 1)
        near = points.where("j >= 0").withColumns({"ti": F.when(inside, F.col("i")).otherwise(i), "tj": F.when(inside, F.col("j")).otherwise(j)})
        p = self.place(F.col("ti"), F.col("tj"))
        wants = near.select(p["block"].cast("int").alias("block"), F.struct("asking", F.col("side").cast("int").alias("side"), "at", p["place"].cast("int").alias("place")).alias("a"))
        return self._kept(wants.groupBy("block").agg(F.collect_list("a").alias("asks")), "asks")

    def moved(self, field: DataFrame, asks: DataFrame) -> DataFrame:
        """(block, rings): the values around each block, the only rows that a step shuffles."""
        met = field.select("block", "values").join(asks.hint("shuffle_hash"), "block")
        picked = met.select(F.explode(F.transform("asks", lambda a: F.struct(a["asking"].alias("asking"), a["side"].alias("side"), a["at"].alias("at"), F.get(F.col("values"), a["place"]).alias("value")))).alias("m")).select("m.*")
        there = picked.withColumnRenamed("asking", "block").repartition(self.buckets, "block")  # as the blocks are dealt
        return there.groupBy("block").agg(F.collect_list(F.struct("side", "at", "value")).alias("rings"))

    def step(self, field: DataFrame, asks: DataFrame) -> DataFrame:
        """The smoothed field, in the same buckets."""

        def run(batches):
            for batch in batches:
                columns = {c: batch.column(c) for c in batch.schema.names}
                out = []
                for k in range(batch.num_rows):
                    width, height = columns["width"][k].as_py(), columns["height"][k].as_py()
                    v = np.asarray(columns["values"][k].values, np.int64).reshape(height, width)
                    around = np.pad(v, 1, mode="edge")
                    rings = columns["rings"][k].values
                    side, at, value = (np.asarray(rings.field(c), np.int64) for c in ("side", "at", "value"))
                    for s, (row, column) in enumerate(((at + 1, np.zeros_like(at)), (at + 1, np.full_like(at, width + 1)), (np.zeros_like(at), at + 1), (np.full_like(at, height + 1), at + 1))):
                        around[row[side == s], column[side == s]] = value[side == s]
                    out.append((4 * v + around[1:-1, :-2] + around[1:-1, 2:] + around[:-2, 1:-1] + around[2:, 1:-1]) // 8)
                values = pa.array([x.ravel() for x in out], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(columns[c] for c in ("block", "x0", "y0", "width", "height")), values], ["block", "x0", "y0", "width", "height", "values"])

        both = field.join(self.moved(field, asks).hint("shuffle_hash"), "block")
        return self._kept(both.select("block", "x0", "y0", "width", "height", "values", "rings").mapInArrow(run, BLOCK), "blocks")

    def points(self, field: DataFrame) -> DataFrame:
        """(i, j, value) of every core point."""
        at = F.posexplode("values").alias("k", "value")
        return field.select("x0", "y0", "width", at).select((F.col("x0") + F.col("k") % F.col("width")).cast("int").alias("i"), (F.col("y0") + F.floor(F.col("k") / F.col("width"))).cast("int").alias("j"), "value")


def smoothed(spark: SparkSession, values: DataFrame, h: Header, steps: int, bands: int = 4, columns: int = 4, buckets: int = 8) -> DataFrame:
    """(i, j, value) at every core point of values (i, j, value), smoothed `steps` times."""
    blocks = Blocks(spark, h, bands, columns, buckets)
    field, asks = blocks.of_values(values), blocks.asked()
    for _ in range(steps):
        field = blocks.step(field, asks)
    return blocks.points(field)
