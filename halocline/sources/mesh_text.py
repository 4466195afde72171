"""Meshes as text for viewers (MSH 2.2), written by Spark as ordered part files and read back from them.

A field on the nodes can go with the mesh; nodes without a value have no line in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import sphere_xyz
from .text_grid import read_lines

COORDINATES = ("ij", "lonlat", "xyz")


def mesh_lines(nodes: DataFrame, cells: DataFrame, coordinates: str = "lonlat", values: DataFrame | None = None) -> DataFrame:
    """(section, number, value): the lines of one part's mesh; nodes (inode, gi, gj, lon, lat), cells (jcell, node0..3, part),
    and values (inode, value)."""
    if coordinates not in COORDINATES:
        raise ValueError(f"coordinates {coordinates!r} are none of {', '.join(COORDINATES)}")
    at = {"ij": (F.col("gi"), F.col("gj"), F.lit(0)), "lonlat": (F.col("lon"), F.col("lat"), F.lit(0)), "xyz": sphere_xyz(F.col("lon"), F.col("lat"))}[coordinates]
    line = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    spark = nodes.sparkSession
    node = nodes.select(F.lit(2).alias("section"), (F.col("inode") + 1).alias("number"), line(F.col("inode") + 1, *at).alias("value"))
    quad = cells.select(F.lit(5).alias("section"), (F.col("jcell") + 1).alias("number"), line(F.col("jcell") + 1, F.lit("3 2 1"), F.col("part"), *[F.col(f"node{k}") + 1 for k in range(4)]).alias("value"))
    count = lambda df, section, head: df.agg(F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("number"), F.concat(F.lit(head + "\n"), F.count(F.lit(1)).cast("string")).alias("value"))
    fixed = spark.createDataFrame([(0, 0, "$MeshFormat\n2.2 0 8\n$EndMeshFormat"), (3, 0, "$EndNodes"), (6, 0, "$EndElements")], "section int, number bigint, value string")
    mesh = fixed.union(count(node, 1, "$Nodes")).union(node).union(count(quad, 4, "$Elements")).union(quad)
    if values is None:
        return mesh
    own = values.where("inode is not null and value is not null")
    data = own.select(F.lit(8).alias("section"), (F.col("inode") + 1).alias("number"), line(F.col("inode") + 1, F.col("value")).alias("value"))
    end = spark.createDataFrame([(9, 0, "$EndNodeData")], "section int, number bigint, value string")
    tags = '$NodeData\n1\n"value"\n1\n0.0\n3\n0\n1'  # one name, one time, three numbers: step, columns, rows
    return mesh.union(count(own, 7, tags)).union(data).union(end)


def write_mesh(nodes: DataFrame, cells: DataFrame, path: str, coordinates: str = "lonlat", values: DataFrame | None = None) -> None:
    """Part files that make the mesh file when put together in order of name."""
    lines = mesh_lines(nodes, cells, coordinates, values)
    lines.repartitionByRange("section", "number").sortWithinPartitions("section", "number").select("value").write.text(path)


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (inode, x, y, z), quadrilaterals (jcell, part, node0..3) and values (inode, value) of a mesh file or its part files.

    Lines are numbered over all files, and told apart by the numbers of the few lines that begin and end sections.
    What isn't a number where one is due is null.
    """
    lines = read_lines(spark, path)
    marks = {r.value: r.line_no for r in lines.where(F.col("value").rlike(r"^\$(End)?(Nodes|Elements|NodeData)$")).groupBy("value").agg(F.min("line_no").alias("line_no")).collect()}
    if not {"$Nodes", "$EndNodes", "$Elements", "$EndElements"} <= marks.keys():
        raise ValueError(f"{path} lacks nodes or elements")
    words = F.split(F.trim("value"), r"\s+")
    word = lambda k, kind: F.get(words, F.lit(k)).try_cast(kind)  # noqa: E731  filters on it may be tried on lines of other sections

    def section(name: str, head: int) -> DataFrame:
        first, end = marks.get(f"${name}", 0) + head, marks.get(f"$End{name}", 0)
        return lines.where((F.col("line_no") > first) & (F.col("line_no") < end))

    nodes = section("Nodes", 1).select((word(0, "bigint") - 1).alias("inode"), *[word(k, "double").alias(c) for k, c in enumerate("xyz", 1)])
    cells = section("Elements", 1).where(word(1, "string") == "3").select((word(0, "bigint") - 1).alias("jcell"), word(4, "int").alias("part"), *[(word(5 + k, "bigint") - 1).alias(f"node{k}") for k in range(4)])
    values = section("NodeData", 8).select((word(0, "bigint") - 1).alias("inode"), word(1, "double").alias("value"))
    return nodes, cells, values
