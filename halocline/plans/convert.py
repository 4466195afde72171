"""Conversion of a grid to the columnar record: read, repair, hash, classify, write and report."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import points, quality, uid
from ..operators.header import Header
from ..sources import netcdf, record, registry, text_grid

#: Formats by the end of a file's name; text without a version is of version 2, anything else a record.
FORMATS = ("netcdf", "text-v1", "text-v2", "record")
ENDINGS = {".nc": "netcdf", ".nc4": "netcdf", ".cdf": "netcdf", ".txt": "text-v2", ".ascii": "text-v2", ".dat": "text-v2"}


def format_of(path: str, asked: str | None = None) -> str:
    if asked and asked not in FORMATS:
        raise ValueError(f"format {asked!r} is none of {', '.join(FORMATS)}")
    return asked or next((f for end, f in ENDINGS.items() if path.lower().endswith(end)), "record")


def read_grid(spark: SparkSession, path: str, name: str, arrangement: str, kind: str, pivot: tuple[float, float] | None = None) -> tuple[Header, DataFrame]:
    """Header and points of a file of any of the formats, halo made consistent."""
    if kind.startswith("text"):
        return read_text_grid(spark, path, f"{name}_{arrangement}", int(kind[-1]), pivot)
    if kind == "netcdf":
        h, own = netcdf.read_netcdf(spark, path, f"{name}_{arrangement}", arrangement)
    else:
        h, own = record.read_record(spark, path)
        h = replace(h, grid=f"{name}_{arrangement}")
    return h, consistent(spark, h, own.select("n", "lon", "lat", "water"))


def consistent(spark: SparkSession, h: Header, own: DataFrame) -> DataFrame:
    """The grid's points with indices and masters, coordinates and mask (n, lon, lat, water) taken from the masters."""
    grid = points.with_ghost(points.with_master(points.spine(spark, h), h), h)
    return grid.join(quality.halo_repaired(grid.join(own, "n")).select("n", "lon", "lat", "water"), "n")


def read_text_grid(spark: SparkSession, path: str, name: str, version: int = 2, pivot: tuple[float, float] | None = None) -> tuple[Header, DataFrame]:
    """Header and points (n, ih, jh, i, j, mi, mj, n_master, ghost, lon, lat, water), halo made consistent."""
    lines = text_grid.read_lines(spark, path)
    head = text_grid.header_fields(lines, version).first().asDict()
    parsed = text_grid.parse_points(lines, version)
    ni, nj = head["ni"], head["nj"]
    if version == 2:
        parsed = text_grid.file_master(text_grid.repaired(parsed), ni)
        halo, at = text_grid.halo_widths(parsed, ni, nj).first().asDict(), text_grid.pivot(parsed, ni, nj).first()
        h = Header(name, ni, nj, **halo, pivot_i=at["pivot_i"], pivot_j=at["pivot_j"])
    else:
        if pivot is None:
            raise ValueError("a grid of version 1 needs its pivot")
        h = Header(name, ni, nj, **{k: head[k] for k in ("halo_n", "halo_w", "halo_s", "halo_e")}, pivot_i=pivot[0], pivot_j=pivot[1])
    h.check()
    return h, consistent(spark, h, parsed.select("n", "lon", "lat", (F.col("water") != 0).alias("water")))


def convert(spark: SparkSession, path: str, name: str, arrangement: str, output: str | None = None, kind: str | None = None, pivot: tuple[float, float] | None = None, diagonal_factor: float = 2.5, compression: str = "zstd") -> dict:
    """Convert a grid; returns the summary: header, hash, resolution and statistics."""
    h, grid = read_grid(spark, path, name, arrangement, format_of(path, kind), pivot)
    grid = grid.persist(StorageLevel.DISK_ONLY)  # read once, used for the hash, the classes and the record
    digest = uid.content_uid(grid, arrangement).first()["uid"]
    classes = quality.classified(quality.cell_corners(grid, h), h, diagonal_factor)
    counts = quality.statistics(classes).first().asDict()
    if output:
        flags = classes.where("flagged").select("ih", "jh", F.lit(True).alias("invalid"))
        full = grid.join(flags, ["ih", "jh"], "left").withColumn("invalid", F.coalesce("invalid", F.lit(False)))
        record.write_record(full, h, output, compression)
    grid.unpersist()
    return {"header": asdict(h), "resolution": f"360/{h.nx}", "pivot": [h.pivot_i, h.pivot_j], "uid": digest, "statistics": counts}


def spec_of(spark: SparkSession, summary: dict, name: str, arrangement: str, output: str) -> str:
    """The registry entry of a converted grid."""
    h = summary["header"]
    row = [(registry.GRID_TYPE, name, arrangement, h["ni"], h["nj"], summary["uid"], output)]
    specs = spark.createDataFrame(row, "grid_type string, grid_name string, arrangement string, ni int, nj int, uid string, data_url string")
    return registry.spec_yaml(specs).first()["yaml"]


def main(args: list[str] | None = None) -> None:
    import argparse
    import json

    p = argparse.ArgumentParser(description="Convert a grid to the columnar record.")
    p.add_argument("path")
    p.add_argument("--name", required=True)
    p.add_argument("--arrangement", required=True, choices="FTUVW")
    p.add_argument("--input-format", choices=FORMATS)
    p.add_argument("--pivot", type=float, nargs=2)
    p.add_argument("--output")
    p.add_argument("--compression", default="zstd")
    p.add_argument("--diagonal-factor", type=float, default=2.5)
    p.add_argument("--yaml", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("convert").getOrCreate()
    out = convert(spark, a.path, a.name, a.arrangement, a.output, a.input_format, tuple(a.pivot) if a.pivot else None, a.diagonal_factor, a.compression)
    print(spec_of(spark, out, a.name, a.arrangement, a.output or a.path) + "\n\n" if a.yaml else "", json.dumps(out, indent=1), sep="")


if __name__ == "__main__":
    main()
