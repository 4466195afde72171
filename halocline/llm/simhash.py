"""SimHash near-duplicates by bit-sliced comparison.

A document's words are lower-cased (A-Z) runs of anything but ASCII white space; its shingles are four words in a row
joined by spaces, repeats included (the whole sequence if it is shorter). Bit b of the fingerprint is 1 if more than
half of the shingles' hashes (XXH64, seed 42) have it. Fingerprints of 4 or fewer differing bits are linked.

Only distinct fingerprints are compared. Two that differ in at most RADIUS bits agree in `agree` of RADIUS + `agree`
slices of their bits, so each fingerprint is dealt to one bucket for every choice of `agree` slices; how many slices
have to agree follows from the number of fingerprints, so that buckets of unrelated ones stay small at any size, and
every choice finds every link. Inside a bucket fingerprints stand vertically: 64 of them make a block of 64 bit planes of
one word each. A fingerprint is compared with a block by adding the differing planes into bit-sliced counters with carry-save
adders, four planes at a time, and the block is abandoned as soon as all its 64 distances exceed the radius.

A bucket yields a forest of links, not pairs: members that are already joined are masked out of what the next ones
find. A bucket of more than CHUNK members is split by a hash into chunks, which are first compared each in itself. Then
the components found so far are counted in every such bucket, and all members outside its largest component are
compared with all its members. Pairs inside one component are never needed, so the work for a large group of near
copies is linear in it, and no link is lost.

Defined results: null or empty text and text without words have fingerprint zero and are linked like any other; a null
doc_id takes part in no link and has a null component; rows repeated with one doc_id are rows each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, rows_of, small_batches, small_side, written
from .ngram_join import components

WIDTH, SEED = 4, 42
RADIUS = 4  # the counters of near_lanes compare with it
BITS, LANES = 64, 64
CHUNK = 8192  # members of a bucket that one task compares with each other
MOST = 256  # mean members of a bucket up to which no more slices have to agree
ITEMS = 1 << 15  # comparisons with a block that run side by side
_ONE, _FULL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The 64-bit SimHash of a text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = np.concatenate([[0], ends[: n - 1]]), ends[-n:] - 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = [line[a:b] for a, b in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)]
        hashes = np.fromiter(map(xxh64_intdigest, part, repeat(SEED)), "<u8", len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed number) of every row."""

    def run(batches):
        for batch in batches:
            rows = [(i, fingerprint(t or "")) for i, t in rows_of([batch], 64)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def slices(n: int) -> tuple[int, list[int]]:
    """How many slices must agree for n fingerprints, and the first bit of each slice with the end of the last."""
    agree = 1
    while n > MOST * 2 ** (BITS * agree // (RADIUS + agree)) and agree < 4:
        agree += 1
    count = RADIUS + agree
    return agree, [BITS * i // count for i in range(count + 1)]


def bucket_keys(fp: Column, n: int) -> Column:
    """An array of structs (choice, value): the bits of every choice of slices that must agree."""
    agree, bounds = slices(n)
    keys = []
    for k, chosen in enumerate(combinations(range(len(bounds) - 1), agree)):
        mask = sum(((1 << bounds[i + 1]) - (1 << bounds[i])) for i in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.struct(F.lit(k).alias("choice"), fp.bitwiseAND(F.lit(signed).cast("bigint")).alias("value")))
    assert len(keys) == comb(RADIUS + agree, agree)
    return F.array(*keys)


def carry_save(a, b, c):
    """Sum and carry of three words of bits."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def near_lanes(planes: np.ndarray, blocks: np.ndarray, asked: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints `asked`, each against one block of bit planes (planes[block, bit]): which lanes are within RADIUS,
    as (item, mask) of the items that have any. `lanes` masks those that count."""
    ones, twos, fours, over = (np.zeros(len(asked), np.uint64) for _ in range(4))
    item, left = np.arange(len(asked)), lanes
    for bit in range(0, BITS, 4):
        d = [planes[blocks, bit + i] ^ (np.uint64(0) - ((asked >> np.uint64(bit + i)) & _ONE)) for i in range(4)]
        ones, first = carry_save(ones, d[0], d[1])
        ones, second = carry_save(ones, d[2], d[3])
        twos, third = carry_save(twos, first, second)
        over |= fours & third  # 8 and more
        fours ^= third
        left = left & ~(over | fours & (ones | twos))  # 5 and more
        if bit >= 12 and (keep := left != 0).sum() < 0.75 * len(keep):  # abandon blocks whose lanes are all too far
            ones, twos, fours, over, item, blocks, asked, left = (x[keep] for x in (ones, twos, fours, over, item, blocks, asked, left))
    keep = left != 0
    return item[keep], left[keep]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give nodes that edges (a, b) connect one label, the smallest of their labels; labels are indexes of nodes with that label."""
    while True:
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        apart = low != high
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(labels, high[apart], low[apart])
        while not np.array_equal(labels, deeper := labels[labels]):
            labels[:] = deeper


def linked(unit: np.ndarray, fps: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """A label for each row, equal for rows of one unit that links connect: the index of one of them.

    Rows of a unit follow each other, those that ask first; each is compared with all that stand behind it. Others'
    links among themselves aren't looked for.
    """
    n = len(fps)
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    sizes = np.diff(np.r_[first, n])
    block_counts = -(-sizes // LANES)
    block_first = np.r_[0, np.cumsum(block_counts)]
    of_row = np.repeat(np.arange(len(first)), sizes)
    place = np.arange(n) - first[of_row]
    lane = block_first[of_row] * LANES + place
    bits = np.zeros((block_first[-1] * LANES, 8), np.uint8)
    bits[lane] = fps.view(np.uint8).reshape(-1, 8)
    valid = np.zeros(len(bits), np.uint8)
    valid[lane] = 1
    valid = np.packbits(valid, bitorder="little").view(np.uint64)
    row_of_lane = np.zeros(len(bits), np.int64)
    row_of_lane[lane] = np.arange(n)
    vertical = np.unpackbits(bits, axis=1, bitorder="little").reshape(-1, LANES, BITS).transpose(0, 2, 1)
    planes = np.packbits(np.ascontiguousarray(vertical), axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    labels, queue, counts = np.arange(n), np.flatnonzero(asks), block_first[of_row + 1] - lane // LANES
    while len(queue):
        take = max(1, int(np.searchsorted(np.cumsum(counts[queue]), ITEMS, side="right")))
        part, queue = queue[:take], queue[take:]
        row = np.repeat(part, counts[part])
        blocks = np.arange(len(row)) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part]) + lane[row] // LANES
        own = blocks == lane[row] // LANES
        lanes = valid[blocks] & np.where(own, _FULL << (lane[row] % LANES).astype(np.uint64) ^ (_ONE << (lane[row] % LANES).astype(np.uint64)), _FULL)
        joined, members = np.unique(labels[part], return_counts=True)
        for label in joined[np.bincount(labels, minlength=n)[joined] >= LANES]:  # large components: leave out their own lanes
            same = np.zeros(len(bits), np.uint8)
            same[lane[labels == label]] = 1
            mine = labels[row] == label
            lanes[mine] &= ~np.packbits(same, bitorder="little").view(np.uint64)[blocks[mine]]
        some = lanes != 0
        row, blocks, lanes = row[some], blocks[some], lanes[some]
        item, masks = near_lanes(planes, blocks, fps[row], lanes)
        if len(item):
            hit, at = np.nonzero(np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            join_labels(labels, row[item[hit]], row_of_lane[blocks[item[hit]] * LANES + at])
    return labels


def bucket_links(rows: DataFrame, key: list[str]) -> DataFrame:
    """Links (a, b) of fingerprints: a forest for every unit of equal `key` of rows (key, fp, asks)."""

    def run(batches):
        held = None
        for batch in batches:
            table = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]
            held = table if held is None else [np.concatenate(x) for x in zip(held, table, strict=True)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in held[:-2]], axis=0)) if len(held[0]) else []
            if len(change):  # the last unit may go on in the next batch
                end = change[-1] + 1
                yield _links([x[:end] for x in held])
                held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield _links(held)

    parted = rows.select(*key, "fp", "asks").repartition(*key).sortWithinPartitions(*key, F.col("asks").desc(), "fp")
    return parted.mapInArrow(run, "a bigint, b bigint")


def _links(table: list[np.ndarray]) -> pa.RecordBatch:
    unit = np.cumsum(np.r_[False, np.any([k[1:] != k[:-1] for k in table[:-2]], axis=0)])
    fps = np.ascontiguousarray(table[-2].astype(np.int64))
    labels = linked(unit, fps.view(np.uint64), table[-1].astype(bool))
    a = np.flatnonzero(labels != np.arange(len(labels)))
    a, b = fps[a], fps[labels[a]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[a != b], b[a != b])], ["a", "b"])


def fingerprint_components(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, component) of the distinct fingerprints `prints` (fp) that have links."""
    n = prints.count()
    dealt = prints.select("fp", F.explode(bucket_keys(F.col("fp"), n)).alias("k")).select("fp", "k.choice", "k.value")
    sizes = dealt.groupBy("choice", "value").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > chunk)
    hot = written(sizes.select("choice", "value", F.ceil(F.col("members") / chunk).cast("int").alias("chunks")), "simhash-hot")  # one row for `chunk` rows at most
    side = small_side(hot, 32)
    of_hot = dealt.join(side, ["choice", "value"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    calm = dealt.join(side, ["choice", "value"], "left_anti") if not hot.isEmpty() else dealt
    rows = calm.withColumn("part", F.lit(0)) if hot.isEmpty() else calm.withColumn("part", F.lit(0)).unionByName(of_hot.drop("chunks"))
    links = written(bucket_links(rows.withColumn("asks", F.lit(True)), ["choice", "value", "part"]), "simhash-links")
    found = components(links)
    made = [hot, links]
    if not hot.isEmpty():
        # Members outside the largest component so far ask all members of their bucket, chunk by chunk.
        named = of_hot.join(found.withColumnRenamed("key", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        named = written(named, "simhash-members")
        per = named.groupBy("choice", "value", "component").agg(F.count(F.lit(1)).alias("members"))
        most = written(per.groupBy("choice", "value").agg(F.max_by("component", F.struct("members", "component")).alias("largest"), (F.sum("members") - F.max("members")).alias("others")), "simhash-largest")
        mixed = small_side(most.where("others > 0").select("choice", "value", "largest", F.ceil(F.col("others") / chunk).cast("int").alias("groups")), 40)
        inside = named.join(mixed, ["choice", "value"])
        members = inside.select("choice", "value", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "fp", F.lit(False).alias("asks"))
        asking = inside.where("component <> largest").withColumn("group", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("groups")).cast("int"))
        asking = asking.select("choice", "value", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), "group", "fp", F.lit(True).alias("asks"))
        more = written(bucket_links(members.unionByName(asking), ["choice", "value", "part", "group"]), "simhash-links")
        if not more.isEmpty():
            found = components(more.union(found.select("key", "component")))
        made += [named, most, more]
    drop_written(*made)
    return found


def near_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    own = written(with_fingerprints(docs), "simhash")
    prints = written(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    of = fingerprint_components(prints.select("fp"), chunk)
    named = prints.join(of.withColumnRenamed("key", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = named.join(least, "component").select("fp", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return own.join(of_print, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
