"""Entry point of the package: registers the grid views and gives grids and meshes by name.

Options are settings of the Spark session, all of which may be left unset:

* halocline.grids.path: registry files to read instead of the built-in registry
* halocline.search.path (parted by commas), halocline.cache.path, halocline.caching: where data files are looked for;
  the cache is one of those places if caching is true
* halocline.validate.uid, halocline.compute.uid: check a grid's hash against its points, or compute it from them
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import local_grid, mesh, partition, uid
from .operators.header import Header, header_of
from .sources import locate, record, registry

VERSION = "0.1.0"
REVISION = "$Format:%H$"  # git puts the commit here when it exports the tree (.gitattributes)
DOMAIN = {"type": "global", "west": 0.0, "east": 360.0, "south": -90.0, "north": 90.0}

#: Builders of headers by grid type, each given a row of the registry; generators of meshes by name.
GRID_TYPES: dict[str, Callable] = {}
MESH_GENERATORS: dict[str, Callable] = {}


def register_grid_type(name: str, builder: Callable) -> None:
    GRID_TYPES[name] = builder


def register_mesh_generator(name: str, generate: Callable) -> None:
    MESH_GENERATORS[name] = generate


def option(spark: SparkSession, name: str, default: str = "") -> str:
    return spark.conf.get(f"halocline.{name}", default)


def enabled(spark: SparkSession, name: str) -> bool:
    return option(spark, name).strip().lower() in ("1", "true", "yes", "on")


def version_number(version: str = VERSION) -> int:
    major, minor, patch = map(int, version.split("."))
    return 10000 * major + 100 * minor + patch


def revision(count: int = 40) -> str:
    return "not available" if REVISION.startswith("$") else REVISION[: min(count, 40)]


def specs(spark: SparkSession, base: str = registry.DEFAULT_BASE) -> DataFrame:
    """The registry: the files of halocline.grids.path, or else the built-in one."""
    path = option(spark, "grids.path")
    return registry.read_specs(spark, path) if path else registry.specs(spark, base)


def install(spark: SparkSession, base: str = registry.DEFAULT_BASE) -> DataFrame:
    """Register the view grid_spec."""
    found = specs(spark, base)
    found.createOrReplaceTempView("grid_spec")
    return found


def spec(spark: SparkSession, key: str) -> dict:
    """The registry's row of a grid, by name or hash in any case."""
    asked = spark.createDataFrame([(key,)], "asked string")
    row = registry.resolve(asked, specs(spark)).first()
    if row["key"] is None:
        raise KeyError(f"no grid is known as {key!r}")
    return row.asDict()


def tripolar_header(row: dict) -> Header:
    return header_of(f"{row['grid_name']}_{row['arrangement']}", row["ni"], row["nj"], row["arrangement"])


def grid(spark: SparkSession, key: str) -> Header:
    """The header of a registered grid, by name or hash in any case."""
    row = spec(spark, key)
    if row["grid_type"] not in GRID_TYPES:
        raise KeyError(f"no grid type is known as {row['grid_type']!r}")
    return GRID_TYPES[row["grid_type"]](row)


def load(spark: SparkSession, key: str, known: tuple[str, ...] = (registry.DEFAULT_BASE,)) -> tuple[Header, DataFrame, str]:
    """Header, points and hash of a registered grid, from its record; the hash is checked or computed if the options say so."""
    row = spec(spark, key)
    cache = option(spark, "cache.path") if enabled(spark, "caching") else None
    store = locate.GridStore(option(spark, "search.path").split(","), cache or None, known)
    h, points = record.read_record(spark, store.locate(spark, row["data_url"]))
    return h, points, uid.checked_uid(points, row["arrangement"], row["uid"], enabled(spark, "validate.uid"), enabled(spark, "compute.uid"))


def generate_mesh(spark: SparkSession, h: Header, parts: int = 1, halo: int = 0, owner: DataFrame | None = None, partitioner: str = partition.DEFAULT_PARTITIONER, generator: str = "tripolar") -> dict[str, DataFrame | dict]:
    """Nodes, cells, links and metadata of all parts; `owner` (n, ix, iy, part) may come from elsewhere."""
    if generator not in MESH_GENERATORS:
        raise KeyError(f"no mesh generator is known as {generator!r}")
    return MESH_GENERATORS[generator](spark, h, parts, halo, owner, partitioner)


def tripolar_mesh(spark: SparkSession, h: Header, parts: int, halo: int, owner: DataFrame | None, partitioner: str) -> dict[str, DataFrame | dict]:
    partition.check_halo(parts, halo)
    own = partition.owners(spark, h, parts, partitioner="serial" if parts == 1 else partitioner) if owner is None else owner
    rect = partition.rectangles(own, halo)
    local = local_grid.local_points(local_grid.extents(rect, h), partition.rectangle_points(rect, own, h, halo), h)
    nodes = mesh.nodes(local, own, h, parts)
    meta = {"parallel": True, "periodic": True, "halo_locked": True, "halo": halo, "virtual_points": 0}
    # Real points of each part, which the reader of one part's mesh is told too.
    real = nodes.where("not is_ghost").groupBy("mypart").count().withColumnRenamed("count", "real_points")
    linked = mesh.with_links(nodes) if parts > 1 else nodes
    return {"nodes": linked, "cells": mesh.cells(nodes, h), "links": mesh.linked(nodes), "real_points": real, "metadata": meta}


register_grid_type(registry.GRID_TYPE, tripolar_header)
register_mesh_generator("tripolar", tripolar_mesh)
