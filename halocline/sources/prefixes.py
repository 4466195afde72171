"""Longest known prefix of each URL, for any number of known prefixes.

The known prefixes are a table; their lengths are few (a URL's length at most), however many prefixes there are. A
URL is cut at every such length, and the cuts are joined with the prefixes on equality of a 64-bit hash and the text: a trie whose edges are
rows. Of the prefixes that a URL starts with, the longest counts. Cuts of URLs that no prefix has leave before anything else.

Defined results: a URL that no prefix begins has a null prefix; a null URL likewise; repeated known prefixes count once,
with the least target; an empty prefix begins every URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import small_side
from .registry import CACHE_FOLDER


def longest_prefix(urls: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """`urls` with prefix and target of the longest known prefix (known: prefix, target). Rows of urls may repeat."""
    own = known.where("prefix is not null").groupBy("prefix").agg(F.min("target").alias("target")).withColumn("key", F.xxhash64("prefix"))
    lengths = sorted(r.size for r in own.select(F.char_length("prefix").alias("size")).distinct().collect())  # a URL's length bounds how many
    each = urls.select(url).where(F.col(url).isNotNull()).distinct()
    sizes = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    cuts = each.select(url, F.explode(F.filter(sizes, lambda n: n <= F.char_length(url))).alias("size")).withColumn("cut", F.substring(F.col(url), F.lit(1), F.col("size"))).withColumn("key", F.xxhash64("cut"))
    side = small_side(own, 200)
    found = cuts.join(side, "key").where("cut = prefix").groupBy(url).agg(F.max(F.struct("size", "prefix", "target")).alias("best"))
    named = found.select(url, F.col("best.prefix").alias("prefix"), F.col("best.target").alias("target"))
    return urls.join(named, url, "left").select(*[urls[c] for c in urls.columns], "prefix", "target")


def cached_path(url: Column, prefix: Column, target: Column) -> Column:
    """Relative path of a data file: behind the target of its known prefix, else by its last part; other paths are kept."""
    rest = F.substring(url, F.char_length(prefix) + 1, F.char_length(url))
    unknown = F.concat(F.lit(f"{CACHE_FOLDER}/unknown"), F.regexp_extract(url, "(/[^/]*)$", 1))
    return F.when(~url.startswith("http"), url).when(prefix.isNull(), unknown).otherwise(F.concat(F.lit(CACHE_FOLDER), target, rest))


def by_host(urls: DataFrame, url: str = "url") -> DataFrame:
    """(host, urls, first_url, last_url, digest): the distinct http URLs of each host; the digest is that of their hashes'
    sum and so independent of their order, and no host's URLs are gathered."""
    each = urls.where(F.col(url).startswith("http")).select(url).distinct()
    piece = F.conv(F.substring(F.md5(F.col(url).cast("binary")), 1, 8), 16, 10).cast("bigint")
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1))
    return each.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("urls"), F.min(url).alias("first_url"), F.max(url).alias("last_url"), F.sum(piece).alias("digest"))
