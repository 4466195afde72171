"""Finding data files: search paths first, then an optional cache; nothing is ever downloaded.

Paths are probed through Spark's file systems, so they may lie in any store that Spark reads. It is driver work on a
handful of paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .record import HEADER, POINTS, VERSION
from .registry import CACHE_FOLDER, DEFAULT_BASE, cached_path


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def report(spark: SparkSession, urls: DataFrame, folder: str, known: tuple[str, ...] = (DEFAULT_BASE,)) -> DataFrame:
    """(data_url, path, found, bytes) of urls (data_url): what of them lies below a folder, listed by Spark."""
    wanted = urls.select("data_url", cached_path(F.col("data_url"), list(known)).alias("path")).distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    there = files.select(F.regexp_extract("path", f"({CACHE_FOLDER}/.*)$", 1).alias("path"), F.col("length").alias("bytes"))
    return wanted.join(there, "path", "left").select("data_url", "path", F.col("bytes").isNotNull().alias("found"), "bytes")


def _of_records(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """Rows of the Parquet files of one kind in all records below a folder, with their record's path; unreadable files have none."""
    read = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", "true").parquet(folder)
    file = F.col("_metadata.file_path")
    return read.where(file.contains(f"/{kind}/")).withColumn("path", F.regexp_extract(file, f"({CACHE_FOLDER}/.*)/{kind}/[^/]*$", 1))


def inspected(spark: SparkSession, wanted: DataFrame, folder: str, known: tuple[str, ...] = (DEFAULT_BASE,)) -> DataFrame:
    """(data_url, path, points, problem) of the records of wanted (data_url, ni, nj) below a folder.

    A record is sound, and its problem null, if its header can be read and has the dimensions that are wanted and its
    points fill the grid once. Else the problem is the first of: missing, header, dimensions, points. All records are read in
    two jobs, their headers and their points' numbers. Rows without a URL are left out; a repeated one is told once, by its
    smallest dimensions.
    """
    asked = wanted.where("data_url is not null").groupBy("data_url").agg(F.min(F.struct("ni", "nj")).alias("d"))
    asked = asked.select("data_url", "d.ni", "d.nj", cached_path(F.col("data_url"), list(known)).alias("path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", f"({CACHE_FOLDER}/.*)/(header|points)/[^/]*$", 1).alias("path"))
    there = files.where("path <> ''").distinct().withColumn("there", F.lit(True))
    heads = _of_records(spark, folder, "header", HEADER).where(F.col("version") == VERSION).groupBy("path").agg(F.min(F.struct("ni", "nj")).alias("head"), F.count(F.lit(1)).alias("heads"))
    n = F.col("n")
    counts = _of_records(spark, folder, "points", POINTS).groupBy("path").agg(F.count(n).alias("points"), F.min(n).alias("least"), F.max(n).alias("most"), F.countDistinct(n).alias("distinct"))
    size = F.col("ni").cast("bigint") * F.col("nj")
    whole = (F.col("points") == size) & (F.col("distinct") == size) & (F.col("least") == 0) & (F.col("most") == size - 1)
    ok = lambda c: F.coalesce(c, F.lit(False))
    problem = F.when(~ok(F.col("there")), "missing").when(~ok(F.col("heads") == 1), "header").when(~ok((F.col("head.ni") == F.col("ni")) & (F.col("head.nj") == F.col("nj"))), "dimensions").when(~ok(whole), "points")
    met = asked.join(there, "path", "left").join(heads, "path", "left").join(counts, "path", "left")
    return met.select("data_url", "path", F.coalesce("points", F.lit(0)).alias("points"), problem.alias("problem"))


def discard_unsound(spark: SparkSession, found: DataFrame, folder: str) -> list[str]:
    """Delete the records that inspected() found unsound below the folder; their URLs, in order."""
    bad = found.where("problem <> 'missing'").select("data_url", "path").orderBy("data_url").collect()  # of the registry's few files
    for row in bad:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{row.path}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return [row.data_url for row in bad]


def wrong_lengths(spark: SparkSession, urls: DataFrame, folder: str, known: tuple[str, ...] = (DEFAULT_BASE,)) -> DataFrame:
    """(data_url, path, length, bytes) of urls (data_url, length) whose file below a folder is missing or not as long as told."""
    seen = report(spark, urls, folder, known)
    told = urls.groupBy("data_url").agg(F.max("length").alias("length"))
    return seen.join(told, "data_url").where(~F.col("found") | (F.col("bytes") != F.col("length"))).select("data_url", "path", "length", "bytes")


class GridStore:
    """Known URL prefixes, and the folders in which their files may be found."""

    def __init__(self, search_paths: list[str], cache: str | None = None, known: tuple[str, ...] = (DEFAULT_BASE,)):
        self.paths = [p for p in search_paths if p] + ([cache] if cache else [])
        self.known = known

    def relative(self, url: str) -> str:
        """Path below a search folder."""
        if not url.startswith("http"):
            return url
        for prefix in self.known:
            if url.startswith(prefix):
                return CACHE_FOLDER + url[len(prefix) :]
        return f"{CACHE_FOLDER}/unknown/{url.rpartition('/')[2]}"

    def locate(self, spark: SparkSession, url: str) -> str:
        """The first place that has the file."""
        if not url.startswith("http") and exists(spark, url):
            return url
        for folder in self.paths:
            path = f"{folder.rstrip('/')}/{self.relative(url)}"
            if exists(spark, path):
                return path
        raise FileNotFoundError(f"{url} is in none of {', '.join(self.paths) or 'no folders'}")

    def fetch(self, url: str) -> str:
        raise NotImplementedError(f"{url} must be put into a search path; downloads are left to other tools")
