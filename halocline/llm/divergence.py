"""Source divergence audit: how the sources of a language differ in their terms.

Terms are runs of letters A-Z and of code points from U+0080 on, A-Z lower-cased. Each language keeps the terms that LEAST
or more of its documents hold. A group (language, source), and likewise a language, gives a kept term with `count`
occurrences p = 1 + floor(SCALE * (count + 1) / (N + V)): N, its occurrences of all kept terms, V, the language's kept
terms. How p stands out against q is f = floor((p - q)^2 / q). All numbers are whole: p is taken in decimals, f in longs
((p - q)^2 is below 2^62).

* Part `pair`: f of a group against another source of its language, summed over all kept terms. Terms without
  occurrences on a side have that side's p of count 0, so the sum is V times f of both such values, corrected by each
  side's buckets of equal count, and by the terms that both sides hold: these come from postings (the sources of one term),
  whose corrections each task adds up for pairs of sources before they are shuffled.
* Part `term`: the `top` terms of a group with p above the language's q. Terms of one count in a group are a bucket and
  share p; the least q among them bounds f. Buckets are taken best bound first: the first that hold `top` terms with p
  above q are evaluated, and their top-th value is the mark. Buckets whose bounds are strictly below it can't hold a
  term of the result; only the others are evaluated.

Counting cuts the bytes of a batch of texts into terms at once and combines in each task, then by (language, term), so neither a hot source nor a frequent term gathers rows. A
term's postings are no more than the sources of a language, whose square is the number of rows returned.

Defined results: null text, language or source is the empty string; rows repeated with one doc_id are documents each; a
language without kept terms has pairs of value 0 and no terms; a source alone in its language has no pairs; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, small_batches, small_side, written

LEAST, TOP, SCALE = 3, 200, 1_000_000_000
HELD = 64 << 20  # bytes of counts that a task gathers before it adds them up, and hands them on if that doesn't halve them
HANDED = 1 << 16  # rows of a batch that is handed on
ITEMS = 1 << 18  # pairs of postings that a task works on at once
#: What a byte of a text is in a term: 0 ends a term, A-Z are lower-cased, bytes from 0x80 on are parts of letters.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[:0x41] = LETTERS[0x5B:0x61] = LETTERS[0x7B:0x80] = 0
LETTERS[0x41:0x5B] += 0x20


def starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, term) of every occurrence, from the bytes of all texts at once: no term passes from one text into the next."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    if ends[0] == ends[-1]:
        return np.empty(0, np.int64), pa.array([], pa.string())
    data = LETTERS[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = data != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(ends))
    for edges, at in ((first, ends[filled]), (last, ends[filled + 1] - 1)):
        edges[at] = inside[at]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    upto = np.r_[0, np.cumsum(last - first + 1)].astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(upto), pa.py_buffer(data[inside])])
    return np.searchsorted(ends, first, side="right") - 1, terms


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents with the term, gathered per task, so rows may repeat."""
    names = ["lang", "source", "term", "n", "docs"]

    def counted(batch: pa.RecordBatch) -> pa.Table:
        row, term = terms_of(batch.column("text"))
        lang, source, term = (x.dictionary_encode() for x in (batch.column("lang"), batch.column("source"), term))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        terms = max(len(term.dictionary), 1)
        # Sorted by text and term: a run is a term of one text. Then by group and term: a run has its texts.
        key = np.sort(row * terms + term.indices.to_numpy())
        at = starts(key)
        n = np.diff(np.r_[at, len(key)])
        key = group[key[at] // terms] * terms + key[at] % terms
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        at = starts(key)
        n, having = np.add.reduceat(n, at) if len(at) else n, np.diff(np.r_[at, len(key)])
        group, code = key[at] // terms, key[at] % terms
        columns = ((lang, group // max(len(source.dictionary), 1)), (source, group % max(len(source.dictionary), 1)), (term, code))
        return pa.table([*(x.dictionary.take(pa.array(k)) for x, k in columns), pa.array(n), pa.array(having)], names)

    def summed(tables: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(tables).group_by(names[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return found.select([*names[:3], "n_sum", "docs_sum"]).rename_columns(names)

    def run(batches):
        gathered, size = [], 0
        for batch in batches:
            gathered.append(counted(batch))
            size += gathered[-1].nbytes
            if size > HELD:
                gathered = [summed(gathered)]
                size = gathered[0].nbytes
                if 2 * size > HELD:
                    yield from gathered[0].to_batches(max_chunksize=HANDED)
                    gathered, size = [], 0
            pa.default_memory_pool().release_unused()
        if gathered:
            yield from summed(gathered).to_batches(max_chunksize=HANDED)

    small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)) of columns."""
    return F.expr(f"1 + cast({count} + 1 as decimal(20,0)) * {SCALE} div ({total} + terms)")


def excess(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / q)."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, lang_n, head): every kept term in every source that holds it, with the language's count;
    `head` marks one row of each term of a language."""
    by_term = Window.partitionBy("lang", "term")
    # Dealt by language and term, so that the sums by source and the window over them need no other shuffle.
    summed = counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = {"lang_n": F.sum("n").over(by_term), "lang_docs": F.sum("docs").over(by_term), "first": F.min("source").over(by_term)}
    return summed.withColumns(over).where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("first")).alias("head"))


def totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total, p0) of every group; p0 is the p of count 0, null without kept terms."""
    found = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("head").cast("bigint")).alias("heads"))
    by_lang = Window.partitionBy("lang")
    filled = found.join(of_group, ["lang", "source"], "left").na.fill(0, ["total", "heads"])
    filled = filled.withColumns({"terms": F.sum("heads").over(by_lang), "lang_total": F.sum("total").over(by_lang)})
    return filled.select("lang", "source", "total", "terms", "lang_total", F.when(F.col("terms") > 0, share("0", "total")).alias("p0"))


def corrections(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): for terms (lang, source, term, p, p0) that two sources hold, what f of both counts
    adds to f of one count and of none, summed by pair of sources over the terms of a task, so rows may repeat."""
    f = lambda p, q: (p - q) ** 2 // q

    def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        first = starts(keys)
        return keys[first], np.add.reduceat(values, first)

    def run(batches):
        names, numbers = [], {}  # groups of this task
        gathered, size = [], 0
        handed = lambda keys, values: pa.RecordBatch.from_arrays([*(pa.array([names[k][i] for k in at], pa.string()) for at, i in ((keys >> 32, 0), (keys >> 32, 1), (keys & 0xFFFFFFFF, 1))), pa.array(values)], ["lang", "source", "item", "value"])

        def pairs(table: pa.Table):
            """Keys (both groups' numbers) and values of all pairs of rows of one term, about ITEMS at a time."""
            code = lambda c: table.column(c).combine_chunks().dictionary_encode()
            lang, source, term = code("lang"), code("source"), code("term")
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            own, group = np.unique(group, return_inverse=True)
            number = []
            for g in own.tolist():
                name = lang.dictionary[g // len(source.dictionary)].as_py(), source.dictionary[g % len(source.dictionary)].as_py()
                if name not in numbers:
                    numbers[name] = len(names)
                    names.append(name)
                number.append(numbers[name])
            number = np.array(number, np.int64)[group]
            p, p0 = (table.column(c).to_numpy() for c in ("p", "p0"))
            first = np.flatnonzero(changes(lang, term))
            sizes = np.diff(np.r_[first, len(p)])
            partners, begin = np.repeat(sizes, sizes), np.repeat(first, sizes)
            upto = np.cumsum(partners)
            at = 0
            while at < len(p):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ITEMS, side="right")))
                n = partners[at:end]
                a = np.repeat(np.arange(at, end), n)
                b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + begin[a]
                a, b = a[a != b], b[a != b]
                if len(a):
                    yield summed(number[a] << 32 | number[b], f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
                at = end

        def changes(lang, term) -> np.ndarray:
            x, y = lang.indices.to_numpy(), term.indices.to_numpy()
            return np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]

        def parts():
            """The rows in tables of whole terms."""
            held = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
                cut = np.flatnonzero(changes(*(held.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term"))))[-1] if held.num_rows else 0
                if cut:
                    yield held.slice(0, cut)
                    held = held.slice(cut)
            if held is not None and held.num_rows:
                yield held

        for table in parts():
            for found in pairs(table):
                gathered.append(found)
                size += len(found[0])
                if size > ITEMS:
                    gathered = [summed(*(np.concatenate(x) for x in zip(*gathered, strict=True)))]
                    size = len(gathered[0][0])
                    if 2 * size > ITEMS:
                        yield handed(*gathered[0])
                        gathered, size = [], 0
        if gathered:
            yield handed(*summed(*(np.concatenate(x) for x in zip(*gathered, strict=True))))

    sorted_rows = rows.select("lang", "source", "term", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return sorted_rows.mapInArrow(run, "lang string, source string, item string, value bigint")


def pair_values(groups: DataFrame, buckets: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language."""
    other = small_side(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), 80)
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"coalesce(terms * {excess('p0', 'q0')}, 0)").alias("value"))
    # A bucket of a source adds to the pair of its source with any other, and to that of the other with it.
    met = buckets.join(other, "lang").where("source <> item")
    sums = met.groupBy("lang", "source", "item").agg(
        F.sum(F.expr(f"members * ({excess('p', 'q0')} - {excess('p0', 'q0')})")).alias("there"),
        F.sum(F.expr(f"members * ({excess('q0', 'p')} - {excess('q0', 'p0')})")).alias("back"),
    )
    sums = sums.select("lang", F.explode(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))).alias("x")).select("lang", "x.*")
    return base.unionByName(sums).unionByName(corrections(rows)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def top_terms(buckets: DataFrame, rows: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of the `top` terms of each group."""
    group = ["lang", "source"]
    bounded = buckets.where("above > 0").withColumn("bound", F.expr(excess("p", "least_q")))
    before = Window.partitionBy(*group).orderBy(F.desc("bound"), "n").rowsBetween(Window.unboundedPreceding, -1)
    ordered = written(bounded.withColumn("before", F.coalesce(F.sum("above").over(before), F.lit(0))), "divergence-bounds")
    by_value = Window.partitionBy(*group).orderBy(F.desc("value"), "item")

    def evaluated(chosen: DataFrame) -> DataFrame:
        side = small_side(chosen.select(*group, "n"), 60)
        values = rows.join(side, [*group, "n"]).where("p > q").select(*group, F.col("term").alias("item"), F.expr(excess("p", "q")).alias("value"))
        return values.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    marks = evaluated(ordered.where(F.col("before") < top)).where(F.col("rank") == top).select(*group, F.col("value").alias("mark"))
    marks = small_side(written(marks, "divergence-marks"), 60)  # a row for each group
    unseen = ordered.join(marks, group, "left").where("mark is null or bound >= mark")
    return evaluated(written(unseen, "divergence-chosen"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank), both parts."""
    kept = written(kept_terms(docs, least), "divergence-terms")
    groups = written(totals(docs, kept), "divergence-groups")
    with_p = kept.join(small_side(groups, 120), ["lang", "source"]).withColumns({"p": share("n", "total"), "q": share("lang_n", "lang_total")})
    rows = written(with_p.select("lang", "source", "term", "n", "p", "q", "p0"), "divergence-shares")
    buckets = rows.groupBy("lang", "source", "n").agg(F.first("p").alias("p"), F.first("p0").alias("p0"), F.count(F.lit(1)).alias("members"), F.min("q").alias("least_q"), F.sum((F.col("p") > F.col("q")).cast("bigint")).alias("above"))
    buckets = written(buckets, "divergence-buckets")
    pairs = pair_values(groups, buckets, rows)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int"))
    drop_written(kept)
    return out(pairs, "pair").unionByName(out(top_terms(buckets, rows, top), "term"))
