"""Line deduplication by site-relative frequency.

Lines are counted per host: the number of its documents that hold a line (each document once) is divided by the host's
number of documents. Lines whose share exceeds `ratio`, on at least `least` documents, are boilerplate and are dropped
from every document of that host.

A host has fewer than (mean number of distinct lines of its documents) / ratio such lines, since every one of them is
in more than `ratio` of its documents; so the digests of a host's boilerplate fit in one array, and documents join
hosts, not lines. Counting combines before its shuffle, so a host or a line with much of the rows stays small.

Lines are compared trimmed of spaces and tabs; blank ones are never dropped, nor counted. Defined results: null text
stays null; a null host is a host of its own; a document all of whose lines go keeps an empty text; repeated rows are
documents each; an empty table gives an empty result; other columns pass through untouched, and a result column whose
name is taken gets underscores before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, fresh, small_side, written

RATIO, LEAST = 0.01, 5  # well below the share of the commonest lines, the same at every size


def host_of_url(url: Column) -> Column:
    """The host of a page's URL, for tables that have one."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def line_key(line: Column) -> Column:
    """Digest of a trimmed line; null for a blank one."""
    trimmed = F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")
    return F.when(trimmed != "", F.unhex(F.md5(trimmed.cast("binary"))))


def boilerplate(docs: DataFrame, host: Column, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, lines): an array of line digests for each host that has boilerplate."""
    keys = F.array_distinct(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), line_key))
    # An empty digest stands for the document itself, so that one pass counts lines and documents.
    rows = docs.select(host.alias("host"), F.explode(F.concat(F.array(F.lit(b"")), F.filter(keys, lambda k: k.isNotNull()))).alias("line"))
    counted = written(rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {least} or length(line) = 0"), "line-counts")
    total = counted.where("length(line) = 0").select(F.col("host").alias("h"), F.col("n").alias("total"))
    over = counted.where("length(line) > 0").join(small_side(total, 120), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.lit(ratio) * F.col("total"))
    lists = written(over.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines")), "boilerplate")
    drop_written(counted)
    return lists


def drop_boilerplate(docs: DataFrame, host: Column, ratio: float = RATIO, least: int = LEAST, clean: str = "clean_text", counts: tuple[str, str] | None = ("n_lines", "n_dropped"), most: float = 1.0) -> DataFrame:
    """`docs` with the text that is left in column `clean`, and the numbers of lines before and dropped.

    A document that would lose more than the share `most` of its characters loses none: where a text is copied to many
    pages, all its lines are as frequent as boilerplate, yet they are what the pages are about."""
    lists = boilerplate(docs, host, ratio, least)
    rows = lists.agg(F.sum(F.size("lines") * 20 + 100)).first()[0] or 0
    name = {k: fresh(docs.columns, k) for k in ("host", "lines", "kept", clean, *(counts or ()))}
    lists = lists.select(F.col("host").alias(name["host"]), F.col("lines").alias(name["lines"]))
    joined = docs.join(F.broadcast(lists) if rows <= 8 << 20 else lists, host.eqNullSafe(F.col(name["host"])), "left")
    split, bad = F.split(F.col("text"), "\n"), F.col(name["lines"])
    kept = F.when(bad.isNull(), split).otherwise(F.filter(split, lambda x: ~F.coalesce(F.array_contains(bad, line_key(x)), F.lit(False))))
    if most < 1:
        left = F.char_length(F.array_join(kept, "\n"))
        kept = F.when(left < F.char_length("text") * (1 - most), split).otherwise(kept)
    out = joined.withColumn(name["kept"], kept)
    own = F.col(name["kept"])
    made = [F.array_join(own, "\n").alias(name[clean])]
    if counts:
        made += [F.coalesce(F.size(split), F.lit(0)).cast("long").alias(name[counts[0]]), F.coalesce(F.size(split) - F.size(own), F.lit(0)).cast("long").alias(name[counts[1]])]
    return out.select(*docs.columns, *made)
