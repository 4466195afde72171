"""N-gram Jaccard join with prefix filters under several global token orders.

A document's set holds its distinct shingles of five words, as 64-bit hashes; documents whose sets have the same 128-bit
digest are one class, which gets a number (`key`) in a written table, and only classes are compared. Two sets of Jaccard similarity 0.8 or more share,
under any global order of tokens, one of the first s - ceil(0.8 s) + 1 tokens of each (s: set size), and l of the first
s - ceil(0.8 s) + l. Filters under three orders are intersected before any two texts meet:

* Second order, by a hash, for sets: one that shares too few of its longer prefix with other sets is left out (`live`).
* First order, rarest first by counts of the sets left, for pairs: they must meet in a prefix token. Tokens of one set
  alone bound what a set can share with any other, so pairs whose bound is too low are never made.
* Second and third order (another hash), for pairs: of those that met under the first, only pairs whose prefixes under
  the second and under the third order meet as well are kept (`sharing`). Only then are their sets intersected.

Groups of many similar sets aren't compared pair by pair: each set is first compared with one other of its most
widespread prefix token; then per token with the set that has fewest tokens of its own, then with others of its size,
always across the components found so far; last, all pairs of different components that still share a prefix token are compared,
which makes the result exact. The work is linear in the tokens but for that last step; nothing is capped. Links are joined to components by alternating stars over written tables.

Tokens found in many sets of a sample (`frequent`) are known to be shared and last in the first order, so their rows
are dealt by set instead of meeting in one task; what later steps need of a token's rows is aggregated and joined back.

Two different shingles are taken for one with a chance of 2^-64 a pair, two different sets with one of 2^-128.
Defined results: no words, empty or null text: no shingles and no links; a null doc_id takes part in no link and has a
null component; rows repeated with one doc_id are that document; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, rows_of, small_batches, small_side, written

WIDTH, PERCENT = 5, 80
ROWS, HELD = 32, 200_000  # texts taken from a batch at once, tokens gathered before they are handed on
#: A token counts as frequent if it is in this share of the sets whose key is divisible by EVERY, and in LEAST of them.
EVERY, SHARE, LEAST = 32, 0.002, 16
LAST = 1 << 60  # place of frequent tokens in the first order
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ORDERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))  # odd: times these, hashes are in another order


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes, rising."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    h = np.full(len(words) - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        h = h * _A + own[i : len(own) - size + 1 + i]
        h ^= h >> np.uint64(29)
    h *= _B
    return np.unique(h ^ (h >> np.uint64(32)))


def set_digest(tokens: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(tokens.tobytes())


def prefix_length(n: int, percent: int = PERCENT, common: int = 1) -> int:
    """Tokens of a set of n among which a similar one has `common` that are in its own prefix as well."""
    return n - (percent * n + 99) // 100 + common


def spare(n: int, percent: int = PERCENT) -> int:
    """The number of common tokens that the longer prefix of a set of n is made for."""
    return max(1, n * (100 - percent) // 100)


def needed(n: int, percent: int = PERCENT) -> int:
    """What a set of n shares at least with any similar one within the longer prefixes: spare() of the smallest partner."""
    return spare((percent * n + 99) // 100, percent)


def in_order(tokens: np.ndarray, order: np.uint64, first: int) -> np.ndarray:
    """The first tokens under an order, as their places in it, which tell tokens apart as well as the tokens do."""
    places = tokens * order
    return np.sort(places if first >= len(places) else np.partition(places, first)[:first])


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def profiles(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and digest of every row."""

    def run(batches):
        for batch in batches:
            rows = [(i, len(s), set_digest(s)) for i, s in ((i, shingles(t or "", width)) for i, t in rows_of([batch], ROWS))]
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["doc_id", "n_shingles", "digest"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary")


def classes(own: DataFrame) -> DataFrame:
    """(key, digest, rep, n) of the classes of profiles: a number, the digest, the smallest doc_id and the size of the set.

    Numbers depend on the order of rows, so they hold only as written here; which documents are linked doesn't depend on them."""
    found = own.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").cast("int").alias("n"))
    return written(found.select(F.monotonically_increasing_id().alias("key"), "digest", "rep", "n"), "classes")


def sets_of(batches, width: int):
    """(key, set) of rows (key, digest, text)."""
    for key, digest, text in rows_of(batches, ROWS):
        s = shingles(text or "", width)
        if set_digest(s) == digest:  # a doc_id with several texts brings those of other classes along
            yield key, s


def tokens(texts: DataFrame, width: int, percent: int | None = None) -> DataFrame:
    """(token, key, n) of every set of texts (key, digest, text); with `percent` only those of its longer prefix, by place in the second order."""

    def run(batches):
        out, keys, sizes, held = [], [], [], 0
        for key, s in sets_of(batches, width):
            own = s if percent is None else in_order(s, ORDERS[0], prefix_length(len(s), percent, spare(len(s), percent)))
            out.append(own)
            keys.append(np.full(len(own), key, np.int64))
            sizes.append(np.full(len(own), len(s), np.int32))
            held += len(own)
            if held > HELD:
                yield _tokens(out, keys, sizes)
                out, keys, sizes, held = [], [], [], 0
        if out:
            yield _tokens(out, keys, sizes)

    return texts.select("key", "digest", "text").mapInArrow(run, "token bigint, key bigint, n int")


def _tokens(out, keys, sizes) -> pa.RecordBatch:
    arrays = [np.concatenate(out).view(np.int64), np.concatenate(keys), np.concatenate(sizes)]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["token", "key", "n"])


def frequent(texts: DataFrame, reps: DataFrame, width: int, percent: int | None) -> DataFrame:
    """Tokens in a good share of the sets of a sample by key, to be broadcast: no more than the mean number of tokens a set by SHARE."""
    part = F.pmod("key", F.lit(EVERY)) == 0
    sets = reps.where(part).count()
    counts = tokens(texts.where(part), width, percent).groupBy("token").agg(F.count(F.lit(1)).alias("sets"))
    return small_side(written(counts.where(F.col("sets") >= max(LEAST, sets * SHARE)).select("token", F.lit(True).alias("often")), "frequent"), 16)


def shared_tokens(texts: DataFrame, reps: DataFrame, width: int, percent: int | None = None) -> DataFrame:
    """(token, key, n, df) of the tokens that two or more sets have; df counts them, and is LAST for frequent ones."""
    rows = tokens(texts, width, percent).join(frequent(texts, reps, width, percent), "token", "left")
    alone = F.when(F.col("often"), F.col("key"))  # frequent tokens are dealt by set
    rows = rows.withColumn("alone", alone).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token", "alone")))
    return rows.where("often or df > 1").select("token", "key", "n", F.when(F.col("often"), F.lit(LAST)).otherwise(F.col("df")).alias("df"))


def with_text(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, digest, text) of the classes in reps (key, digest, rep)."""
    side = small_side(reps.select(F.col("rep").alias("__rep"), "key", "digest"), 56)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(side, F.col("doc_id") == F.col("__rep")).select("key", "digest", "text")


def live(texts: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, digest, rep, n) of the classes that share enough tokens of their longer prefix under the second order with others."""
    n, up = F.col("n"), lambda x, by: F.floor((x + by - 1) / by)
    smallest = up(n * percent, 100)
    need = F.greatest(F.lit(1), F.floor(smallest * (100 - percent) / 100))
    shared = shared_tokens(texts, reps, width, percent).groupBy("key").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("shared"))
    return reps.join(shared.where(F.col("shared") >= need).select("key"), "key", "left_semi")


def prefixes(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, second, third): the prefixes of every set under the second and third order, by half of each token's place.

    Halves may be equal where tokens are not, so that a filter on them lets a few pairs more through, and never one less."""

    def run(batches):
        rows = [[], [], []]
        for key, s in sets_of(batches, width):
            first = prefix_length(len(s), percent)
            for column, value in zip(rows, (key, *((in_order(s, o, first) >> np.uint64(32)).astype(np.uint32).view(np.int32) for o in ORDERS)), strict=True):
                column.append(value)
            if len(rows[0]) >= 256:
                yield _prefixes(rows)
                rows = [[], [], []]
        if rows[0]:
            yield _prefixes(rows)

    return texts.select("key", "digest", "text").mapInArrow(run, "key bigint, second array<int>, third array<int>")


def _prefixes(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in rows[1:])], ["key", "second", "third"])


def sharing(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes (key, second, third) meet under the second and the third order."""
    side = lambda k: of.select(F.col("key").alias(k), F.col("second").alias(f"second_{k}"), F.col("third").alias(f"third_{k}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return joined.where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar. Pairs must share prefix tokens under the second and third order
    before their whole texts meet, each pair once."""
    ends = written(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct().join(reps, "key").select("key", "digest", "rep"), "pair-ends")
    texts = with_text(docs, ends)
    own = written(prefixes(texts, width, percent), "prefixes-by-hash")
    left = written(sharing(pairs, own), "candidates")
    drop_written(own)
    side = lambda k: texts.select(F.col("key").alias(k), F.struct("digest", "text").alias(f"own_{k}"))
    columns = ["a", "own_a.digest", "own_a.text", "b", "own_b.digest", "own_b.text"]
    joined = left.join(side("b"), "b").join(side("a"), "a").select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))

    def run(batches):
        last, held = None, None
        for batch in batches:
            found = []
            for a, digest_a, text_a, b, digest_b, text_b in rows_of([batch], ROWS):
                if a != last or set_digest(held) != digest_a:
                    last, held = a, shingles(text_a or "", width)
                other = shingles(text_b or "", width)
                if set_digest(held) == digest_a and set_digest(other) == digest_b and similar(held, other, percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    links = written(joined.mapInArrow(run, "a bigint, b bigint").distinct(), "links")
    drop_written(ends, left)
    return links


def all_stars(edges: DataFrame) -> bool:
    """Whether every edge (u, v) hangs a node that has no other edge on one that hangs on none."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.hangs").alias("hangs"), F.min("e.hangs").alias("least"))
    return nodes.where("hangs > 1 or hangs = 1 and least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(key, component): the smallest key reachable, for every key in an edge (a, b), by alternating large and small stars.

    A large star hangs a node's larger neighbours on its smallest one. It joins, so that Spark can split the rows of a
    node with very many neighbours; the small star that follows only sees the few smaller ones of a node.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not all_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = written(small, "edges")
        drop_written(edges)
        edges = new
    roots = edges.select(F.col("v").alias("key")).distinct().select("key", F.col("key").alias("component"))
    return edges.select(F.col("u").alias("key"), F.col("v").alias("component")).union(roots)


def rare_prefixes(texts: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """(token, key, n, shared, place): prefix tokens, rarest first, that two or more sets have. `shared` counts all such
    tokens of the set, in its prefix or not; `place` is the token's among all tokens of the set, from 1."""
    by_key = Window.partitionBy("key")
    rows = shared_tokens(texts, reps, width).withColumns({"shared": F.count(F.lit(1)).over(by_key).cast("int"), "rank": F.row_number().over(by_key.orderBy("df", "token"))})
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    place = (F.col("n") - F.col("shared") + F.col("rank")).cast("int")
    return rows.withColumn("place", place).where(F.col("place") <= length).select("token", "key", "n", "shared", "place")


def within_bound(a: str, b: str, percent: int, first: bool = True):
    """Whether two sets (structs with n, shared and place) that meet in a token could be similar.

    They can't share more than either shares with others; and their first common token can't stand so late in either
    that too few tokens follow. A similar pair passes at its first common token, and with `first` unset at any.
    """
    left = lambda x: F.least(F.col(f"{x}.shared"), F.col(f"{x}.n") - F.col(f"{x}.place") + 1) if first else F.col(f"{x}.shared")
    return F.least(left(a), left(b)) * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent


ONE = ("key", "n", "shared", "place", "c")  # what pairs need to know of a set at a token; c is its component so far


def with_leaders(members: DataFrame, rows: DataFrame, order, percent: int, first: bool = True) -> DataFrame:
    """Pairs (a, b) of each member and the first by `order` among the sets of its token, if they aren't in one component."""
    leaders = rows.groupBy("token").agg(F.min(F.struct(order.alias("o"), *ONE)).alias("y"))
    pairs = members.select("token", F.struct(*ONE).alias("x")).join(leaders, "token").where((F.col("x.c") != F.col("y.c")) & within_bound("x", "y", percent, first))
    return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def with_varied_leaders(rows: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs (a, b) of each set and one of each of its tokens, chosen by a hash of both among those of a like size.

    So a set meets about as many others as it has tokens, but never more: pairs are linear in the rows. Where many sets
    of a group are similar to some of the others only, this joins nearly all that belong together."""
    bucket = F.floor(F.log("n") / F.log(F.lit(100 / percent)))  # sizes of similar sets are in the same one or in the next
    of = F.struct(F.xxhash64("key", "token", F.lit(seed)).alias("o"), *ONE)
    leaders = rows.groupBy("token", bucket.alias("near")).agg(F.min(of).alias("y"))
    leaders = leaders.select("token", F.explode(F.array(F.col("near") - 1, F.col("near"), F.col("near") + 1)).alias("near"), "y")
    members = rows.select("token", bucket.alias("near"), F.struct(*ONE).alias("x"))
    pairs = members.join(leaders, ["token", "near"]).where((F.col("x.c") != F.col("y.c")) & within_bound("x", "y", percent, first=False))
    return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def widest(rows: DataFrame) -> DataFrame:
    """The row of each set whose token is in the prefixes of the most sets."""
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("sets"))
    best = F.max(F.struct("sets", "token", *ONE[1:])).alias("b")
    return rows.join(counts, "token").groupBy("key").agg(best).select("b.token", "key", *[f"b.{c}" for c in ONE[1:]])


def class_components(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, component) of the classes that have links.

    In five steps, each for pairs across the components that those before have found: every set with the leader of its
    most widespread token, which joins large groups with one pair a set; with the leaders of all its tokens; twice with
    leaders of its size that differ from token to token; last with all other sets of its tokens.
    """
    left = written(live(with_text(docs, reps), reps, width, percent), "live")
    rows = written(rare_prefixes(with_text(docs, left), left, width, percent), "prefixes")
    done, of, tried = [left, rows], None, None
    for step in ("widest", "fewest", "varied", "again", "all"):
        if of is None:
            found = rows.withColumn("c", F.col("key"))
        else:
            found = rows.join(of.withColumnRenamed("component", "c"), "key", "left").withColumn("c", F.coalesce("c", "key"))
            mixed = found.groupBy("token").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("token")
            found = written(found.join(mixed, "token", "left_semi"), "mixed-prefixes")
            done.append(found)
        if step == "widest":
            pairs = with_leaders(widest(found), found, F.col("n") - F.col("shared"), percent, first=False)
        elif step == "fewest":
            pairs = with_leaders(found, found, F.col("n") - F.col("shared"), percent)
        elif step in ("varied", "again"):
            pairs = with_varied_leaders(found, percent, len(step))
        else:
            one = F.struct(*ONE)
            apart = (F.col("x.key") < F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & within_bound("x", "y", percent)
            pairs = found.select("token", one.alias("x")).join(found.select("token", one.alias("y")), "token").where(apart).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        done.append(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        if not pairs.isEmpty():
            links = verified(pairs, left, docs, width, percent)
            if not links.isEmpty():
                of = components(links if of is None else links.union(of.select("key", "component")))
            drop_written(links)
    drop_written(*done)
    return of if of is not None else reps.select("key", F.col("key").alias("component")).limit(0)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    own = written(profiles(docs, width), "profiles")
    reps = classes(own)
    named = reps.join(class_components(docs, reps, width, percent), "key", "left").select("digest", "rep", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_digest = named.join(least, "component").select("digest", "component_id")
    # Only classes of several documents or with links need the join; the others are their own component.
    out = own.join(of_digest, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def without_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """`docs` with one document, that of the smallest doc_id, of each component."""
    found = near_duplicates(docs.select("doc_id", "text"), width, percent)
    gone = written(found.where("component_id <> doc_id").select("doc_id"), "near-duplicates")
    return docs.join(small_side(gone, 24), "doc_id", "left_anti").select(*docs.columns)
