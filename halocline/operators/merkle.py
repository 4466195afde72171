"""Content hashes of fields as trees.

Points are cut by number into chunks; a chunk's digest is that of its values in order, and FAN digests of one level, in
order, make one of the next, up to a single root. Every level is an aggregation, so no task sees more than a chunk or FAN
digests, and the root is the same however the rows are dealt. Two trees of one shape are compared from the root down:
only the children of nodes that differ are looked at, so what is read of the trees grows with the differences.

Values are hashed as text (whole numbers; null is `-`), one per line as `n:value`. Points that are missing change the digest as others
would; a field without points has no root. Numbers of points are distinct and not negative.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

CHUNK, FAN = 4096, 64


def levels_of(size: int, chunk: int = CHUNK, fan: int = FAN) -> int:
    """Levels of the tree over points 0 to size - 1, the root's included."""
    nodes, levels = max(1, -(-size // chunk)), 1
    while nodes > 1:
        nodes, levels = -(-nodes // fan), levels + 1
    return levels


def tree(field: DataFrame, size: int, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(level, node, digest) of a field (n, value) of numbers below `size`; level 0 has the chunks."""
    line = F.concat_ws(":", F.col("n").cast("string"), F.coalesce(F.col("value").cast("bigint").cast("string"), F.lit("-")))
    in_order = lambda key, what: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), what.alias("v")))), lambda x: x["v"]), "\n")
    node = F.floor(F.col("n") / chunk).cast("bigint").alias("node")
    level = written(field.groupBy(node).agg(F.sha2(in_order("n", line), 256).alias("digest")), "merkle")
    levels = [level.select(F.lit(0).alias("level"), "node", "digest")]
    for k in range(1, levels_of(size, chunk, fan)):
        level = level.groupBy(F.floor(F.col("node") / fan).cast("bigint").alias("node")).agg(F.sha2(in_order("node", F.col("digest")), 256).alias("digest"))
        levels.append(level.select(F.lit(k).alias("level"), "node", "digest"))
    return reduce(DataFrame.unionByName, levels)


def root(nodes: DataFrame) -> str | None:
    """The digest of the highest level; None for a field without points."""
    top = nodes.orderBy(F.desc("level")).limit(1).collect()
    return top[0]["digest"] if top else None


def differing(a: DataFrame, b: DataFrame, size: int, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(first_n, end_n) of the chunks in which two fields differ, found from the roots of their trees down."""
    path = None
    for level in range(levels_of(size, chunk, fan) - 1, -1, -1):
        left, right = (t.where(F.col("level") == level).select("node", F.col("digest").alias(d)) for t, d in ((a, "a"), (b, "b")))
        if path is not None:  # only below nodes that differ
            under = path.select(F.explode(F.sequence(F.col("node") * fan, F.col("node") * fan + fan - 1)).alias("node"))
            under = written(under, "merkle-path")
            left, right = left.join(under, "node", "left_semi"), right.join(under, "node", "left_semi")
        path = left.join(right, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
    return path.select((F.col("node") * chunk).alias("first_n"), F.least((F.col("node") + 1) * chunk, F.lit(size)).cast("bigint").alias("end_n"))
