"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest hash among its inner s-mers lies at its first or last place
(the leftmost smallest counts). Whether a k-mer is chosen depends on its own characters alone, so an edit disturbs only
the anchors that overlap it. A fingerprint holds the anchors whose hashes lie below a fixed threshold, a share of all that grows
with the text, and at least the KEPT smallest, as text: `hash@position` joined by commas in order of hash, each hash once
at its first position. Texts without any anchor get one for the whole text.

Likeness matches anchors of equal hash, keeps the longest chain of them that rises in position in both texts, so that
edits may move what follows them, estimates the share of anchors in common among the smallest of both, and turns it into
the share of text in common (0 to 1). Two empty fingerprints are alike (1), an empty and a full one are not (0).

Defined results: null counts as empty text, whose fingerprint is empty; a null doc_id sorts first; rows repeated with
one doc_id follow each other in order of text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, small_batches

K, S, KEPT, RANGES_A_TASK = 16, 8, 128, 8
THRESHOLD = 1 << 28  # of 32-bit hashes: one anchor of 16
OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams(points: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` code points."""
    h = np.zeros(len(points) - size + 1, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : len(points) - size + 1 + i]
    return _mixed(h)


def syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the closed syncmers of an array of code points."""
    n = len(points) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    inner, places = _grams(points, s), k - s + 1
    least = inner[:n].copy()
    for i in range(1, places):
        np.minimum(least, inner[i : n + i], out=least)
    first, last = inner[:n] == least, inner[places - 1 : n + places - 1] == least
    for i in range(1, places - 1):  # the leftmost smallest must be the last place
        last &= inner[i : n + i] != least
    at = np.flatnonzero(first | last)
    if not len(at):
        return at, np.empty(0, np.uint32)
    own = np.zeros(len(at), np.uint64)
    for i in range(0, k, s):  # the k-mer's hash from those of its s-mers
        own = _mixed(own * np.uint64(0x9E3779B97F4A7C15) + inner[at + min(i, k - s)])
    return at, (own >> np.uint64(32)).astype(np.uint32)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, rising and distinct, and positions of the anchors that a fingerprint keeps."""
    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    at, hashes = syncmers(points)
    if not len(at):
        digest = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
        return np.frombuffer(digest[:4], "<u4").astype(np.uint32), np.zeros(1, np.int64)
    hashes, index = np.unique(hashes, return_index=True)
    size = max(KEPT, int(np.searchsorted(hashes, THRESHOLD)))
    return hashes[:size], at[index[:size]]


def known_below(hashes: np.ndarray) -> int:
    """Below which hash a fingerprint has all anchors of its text."""
    return 1 << 32 if len(hashes) < KEPT else max(int(hashes[-1]) + 1, THRESHOLD)


def shown(found: tuple[np.ndarray, np.ndarray]) -> str:
    return ",".join(f"{h:08x}@{p}" for h, p in zip(found[0].tolist(), found[1].tolist(), strict=True))


def longest_rise(places: list[int]) -> int:
    """Length of the longest strictly rising subsequence."""
    ends: list[int] = []  # the smallest last place of a run of each length
    for p in places:
        k = bisect_left(ends, p)
        ends[k : k + 1] = [p]
    return len(ends)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    # Beyond what both sides know, one may lack anchors that its text has.
    limit = min(known_below(a[0]), known_below(b[0]))
    union = len(np.union1d(a[0][a[0] < limit], b[0][b[0] < limit]))
    inside = a[0][i] < limit
    same = longest_rise(b[1][j][inside][np.argsort(a[1][i][inside], kind="stable")].tolist()) / union
    return 2 * same / (1 + same)


def edited(text: str, after: str) -> str:
    """The last half replaced by as many characters from the start of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def described(doc_id, text: str, own, after: str, next_anchors) -> tuple:
    new = edited(text, after)
    changed = anchors(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), shown(own), shown(changed), likeness(own, changed), likeness(own, next_anchors)


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per document with its fingerprint and those of its edited text, next document in order of doc_id.

    The documents are dealt into ranges of doc_id, several a task, bounded by approximate quantiles. The first document
    of each range is dealt once more, as the end of the range before it (that of the first range ends the last one), so
    that every document meets its next one in its own task, where the ranges stream past in order. What the driver and
    the tasks hold of the ranges is a few numbers each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranges = RANGES_A_TASK * n
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.float64), side="right")), dtype="int32")

    dealt = rows.withColumn("range", range_of("doc_id"))
    firsts = {r.range: r.doc_id for r in dealt.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("f")).select("range", "f.doc_id").collect()}
    order = sorted(firsts)
    ends = spark.createDataFrame([(r, firsts[after]) for r, after in zip(order, order[1:] + order[:1], strict=True)], "range int, first bigint")
    again = rows.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", "range", F.lit(True).alias("end"))  # a row for each range

    def walk(batches):
        held = None  # the document before, of the same range
        for batch in batches:
            out = []
            for end, doc_id, text in rows_of([batch], 32):
                text = text or ""
                if end and held is None:
                    continue  # a further row with the doc_id of the range's end
                own = anchors(text)
                if held is not None:
                    out.append(described(*held, text, own))
                held = None if end else (doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(KINDS)], [x.split()[0] for x in OUT.split(", ")])

    met = dealt.withColumn("end", F.lit(False)).unionByName(again).repartition(n, "range").sortWithinPartitions("range", "end", "doc_id", "text")
    return met.select("end", "doc_id", "text").mapInArrow(walk, OUT)
