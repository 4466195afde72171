"""Filter interaction audit by the Walsh-Hadamard transform.

Five filters A to E are applied to whole texts; a document's failures are a mask of five bits, of which every order of
the filters sees the same. For each part (a source) and for all, good and toxic documents the 32 signed parity sums

    S[w] = sum over documents of (-1) ^ (number of bits in w and mask)

are aggregated; they add up over tasks in one row a part, whatever the skew. The transform is its own inverse but for a
factor of 32, so the numbers of documents of each mask come back exactly: cell[m] = sum over w of (-1)^|w and m| S[w] / 32.
All 120 orders are evaluated on the cells. A document that fails k filters is removed by each of them in 120 / k of the
orders, which gives what a filter removes over all orders (its Shapley value times 120) in closed form.

Filters fail a text of A: fewer than MIN_WORDS words; B: 100 * distinct words < PERCENT_DISTINCT * words; C: 100 *
capitals A-Z > PERCENT_CAPITALS * code points; D: any of the signs #$%&*|; E: the text is that of a smaller doc_id anywhere
in the table. Words are runs of anything but ASCII white space, case counts.

Defined results: null texts and sources are empty strings; a null doc_id is neither smaller nor larger than any other
(E never fails it); rows repeated with one doc_id are documents each and not copies of each other; repeated labels of
one doc_id count as 1 if any is; null labels count as 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, written

FILTERS = "ABCDE"
MIN_WORDS, PERCENT_DISTINCT, PERCENT_CAPITALS = 50, 65, 5
CELLS = 1 << len(FILTERS)
KINDS = ("all", "good", "toxic")
OUT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> Column:
    """The mask of the filters that look at a text alone: bit 0 is A."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    fails = [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < PERCENT_DISTINCT * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > PERCENT_CAPITALS * F.char_length(text).cast("bigint"),
        text.rlike("[#$%&*|]"),
    ]
    mask = F.lit(0)
    for bit, fail in enumerate(fails):
        mask = mask + fail.cast("int") * (1 << bit)
    return mask


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = written(rows, "filter-masks")
    # Only texts of several documents can be copies; the counts combine before they are shuffled.
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first")
    copied = rows.join(small_side(written(firsts, "filter-copies"), 64), "digest", "left")
    mask = F.col("mask") + F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    return copied.select("doc_id", "part", mask.alias("mask")).join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def parity_sums(failed: DataFrame) -> DataFrame:
    """(part, all, good, toxic): arrays of the 32 signed parity sums."""
    sign = lambda w: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(w))) % 2)
    sums = [F.sum(sign(w) if kind == "all" else F.when(F.col(kind), sign(w)).otherwise(0)).alias(f"{kind}{w}") for kind in KINDS for w in range(CELLS)]
    return failed.groupBy("part").agg(*sums).select("part", *[F.array(*[F.col(f"{kind}{w}") for w in range(CELLS)]).alias(kind) for kind in KINDS])


def inverted(sums: np.ndarray) -> np.ndarray:
    """Numbers of documents by mask from the parity sums (last axis), by the fast transform."""
    out = sums.copy()
    step = 1
    while step < CELLS:
        pairs = out.reshape(*out.shape[:-1], -1, 2, step)
        out = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(out.shape)
        step *= 2
    cells, rest = np.divmod(out, CELLS)
    if rest.any() or (cells < 0).any():
        raise ValueError("these are no parity sums")
    return cells


def audited(cells: np.ndarray) -> list[tuple]:
    """(filter_order, step, *OUT) of all orders for the cells of one part (kind, mask)."""
    masks = np.arange(CELLS)
    failed = np.array([m.bit_count() for m in range(CELLS)])
    bits = [masks >> i & 1 == 1 for i in range(len(FILTERS))]
    shapley = [int((cells[0][own] * (120 // failed[own])).sum()) for own in bits]
    alone = [int(cells[0][1 << i]) for i in range(len(FILTERS))]
    rows = []
    for order in permutations(range(len(FILTERS))):
        gone = np.zeros(CELLS, bool)
        for step, i in enumerate(order, 1):
            here, again = bits[i] & ~gone, bits[i] & gone
            gone = gone | bits[i]
            counted = cells[0][~gone], cells[0][here], cells[0][again]
            rows.append(("".join(FILTERS[k] for k in order), step, *(int(x.sum()) for x in counted), alone[i], int(cells[1][here].sum()), int(cells[2][here].sum()), shapley[i]))
    return rows


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    sums = written(parity_sums(failures(docs, labels)), "filter-parities")

    def run(batches):
        for batch in batches:
            for part, *kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(part, *r) for r in audited(inverted(np.array(kinds, np.int64)))]
                columns = list(zip(*rows, strict=True))
                types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(OUT)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "filter_order", "step", *OUT])

    return sums.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in OUT))
