"""SimHash components, source divergence and filter interactions against plain versions and on awkward rows."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from halocline.llm import divergence, filter_audit, queries, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items):
    """Smallest index reachable by links of 4 or fewer differing bits."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i] ^ items[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_simhash_query_matches_plain_version(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    prints = [plain_fingerprint(t) for _, t in docs]
    roots = plain_components(prints)
    want = [(i, f"{p:016x}", docs[r][0]) for (i, _), p, r in zip(docs, prints, roots, strict=True)]
    assert sorted(map(tuple, queries.op11_simhash(spark, sf).collect())) == want
    assert len({w[2] for w in want}) < len(want)


def clustered(seed, unrelated, near, flips):
    """Unrelated fingerprints, and a crowd around one of them, of which some are beyond the radius of all but each other."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(unrelated)}
    centre = rng.getrandbits(64)
    for _ in range(near):
        bits = rng.sample(range(64), rng.randint(0, flips))
        out.add(centre ^ sum(1 << b for b in bits))
    return sorted(out)


@pytest.mark.parametrize("chunk, flips", [(4, 9), (50, 3), (8192, 9)])
def test_simhash_components_with_split_buckets(spark, chunk, flips):
    """Buckets of more than `chunk` members are split and still find every link."""
    items = clustered(chunk, 300, 250, flips)
    signed = [x - (1 << 64) if x >> 63 else x for x in items]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint").repartition(3)
    got = {r.key: r.component for r in simhash.fingerprint_components(df, chunk).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for k, s in enumerate(signed):
        groups[got.get(s, s)].add(k)
    for k, root in enumerate(plain_components(items)):
        want[root].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_more_slices_agree_for_more_fingerprints(spark):
    assert [simhash.slices(n)[0] for n in (0, 10**6, 10**7, 10**9, 10**12)] == [1, 1, 2, 3, 4]
    rng = random.Random(7)
    for n in (10, 10**7, 10**9, 10**12):
        agree, bounds = simhash.slices(n)
        assert len(bounds) == 5 + agree and bounds[0] == 0 and bounds[-1] == 64
        x = rng.getrandbits(63)
        rows = [(x, x ^ sum(1 << b for b in rng.sample(range(63), 4))) for _ in range(20)]
        df = spark.createDataFrame(rows, "a bigint, b bigint")
        shared = df.select(simhash.bucket_keys(df.a, n).alias("a"), simhash.bucket_keys(df.b, n).alias("b")).selectExpr("size(array_intersect(a, b)) AS n")
        assert all(r.n > 0 for r in shared.collect())


def test_bit_sliced_distances():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 200, np.uint64)
    for k in range(1, 100):
        fps[k] = fps[0] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k % 8).astype(np.uint64)) if k % 8 else fps[0]
    labels = simhash.linked(np.repeat([0, 1], 100), fps, np.ones(200, bool))
    for part in (slice(0, 100), slice(100, 200)):
        want = plain_components([int(x) for x in fps[part]])
        assert [int(x) - part.start for x in labels[part]] == want


def test_simhash_on_awkward_rows(spark, documents, no_documents):
    rows = documents.collect()
    got = simhash.near_duplicates(documents).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r.doc_id, f"{plain_fingerprint(r.text):016x}") for r in rows)
    of = {r.doc_id: r.component_id for r in got}
    assert of[None] is None and of[1] == of[2] == 1 and of[3] == of[4] == of[5] == 3 and of[6] == of[7] == 6
    assert simhash.near_duplicates(no_documents).count() == 0


def plain_divergence(rows, least=3, top=200):
    """Sets of result rows, of rows (lang, source, text)."""
    groups, lang_n, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        groups[lang, source].update(words)
        lang_n[lang].update(words)
        held[lang].update(set(words))
    kept = {lang: [w for w in held[lang] if held[lang][w] >= least] for lang, _ in groups}
    p_of = lambda counts, lang: {w: 1 + 10**9 * (counts[w] + 1) // (sum(counts[x] for x in kept[lang]) + len(kept[lang])) for w in kept[lang]}
    p = {g: p_of(c, g[0]) for g, c in groups.items()}
    q = {lang: p_of(lang_n[lang], lang) for lang in kept}
    f = lambda a, b: (a - b) ** 2 // b
    out = set()
    for lang, source in groups:
        own = p[lang, source]
        pairs = [(sum(f(own[w], p[lang, other][w]) for w in kept[lang]), other) for of, other in groups if of == lang and other != source]
        terms = [(f(own[w], q[lang][w]), w) for w in kept[lang] if groups[lang, source][w] and own[w] > q[lang][w]]
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= top:
                    out.add((lang, source, part, item, value, rank))
    return out


@pytest.mark.parametrize("top", [1, 5, 200])
def test_divergence_matches_plain_version(spark, sf, top):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.lang, r.source if r.doc_id % 3 else None, r.text) for r in docs.collect()]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    got = divergence.divergence(df, top=top).collect()
    want = plain_divergence(rows, top=top)
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_divergence_ties_small_batches_and_awkward_rows(spark, documents, no_documents, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "ITEMS", 4)
    texts = ["a b c", "A b ß", "a c ß", "b c Ä", "", None, "a a a b", "zz", "a\tb,c"]
    rows = [(lang, f"s{k % 4}" if k % 4 else None, t) for lang in ("x", None, "y") for k, t in enumerate(texts)] + [("alone", "s", "a a"), ("two", "s", "q"), ("two", "t", None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
    got = divergence.divergence(df).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_divergence(rows)
    assert ("two", "s", "pair", "t", 0, 1) in set(map(tuple, got)) and not [r for r in got if r.lang == "alone"]
    rows = [(r.lang, r.source, r.text) for r in documents.collect()]
    assert set(map(tuple, divergence.divergence(documents).collect())) == plain_divergence(rows)
    assert divergence.divergence(no_documents).count() == 0


def test_divergence_terms_of_texts_side_by_side():
    rng = random.Random(5)
    pieces = ["a", "Z", "zA", " ", "\0", "@", "[", "`", "{", "\x7f", "\x80", "\x85", "\xa0", "\u212a", "\u0130", "\u00c4", "\u5b57", "\U0001f600"]
    texts = ["ab", "CD", "", "", "e\u00c4", "\u00e4", "?", "f"] + ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(400)]
    cut = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t))
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(texts, kind)
        for part, own in ((whole, texts), (whole.slice(1, 300), texts[1:301]), (whole.slice(2, 2), texts[2:4]), (whole.slice(0, 0), [])):
            rows, terms = divergence.terms_of(part)
            assert list(zip(rows.tolist(), terms.to_pylist())) == [(k, w) for k, t in enumerate(own) for w in cut(t)]


def test_divergence_counts_are_added_up_in_the_task(spark):
    """Terms of a task beyond 300,000 leave it once, however many of its texts repeat them."""
    word = F.translate(F.col("id").cast("string"), "0123456789", "aBcdefghij")
    text = spark.range(301_000).agg(F.concat_ws(" ", F.sort_array(F.collect_list(word)), F.lit("a A")).alias("text"))
    docs = text.crossJoin(spark.range(2)).select(F.lit("x").alias("lang"), F.lit("s").alias("source"), "text").coalesce(1)
    got = divergence.counts(docs).groupBy("n", "docs").agg(F.count(F.lit(1)).alias("rows")).collect()
    assert sorted(map(tuple, got)) == [(2, 2, 300_999), (6, 2, 1)]
    none = docs.select("lang", "source", F.lit(" 1\t").alias("text"))
    assert divergence.counts(none).count() == 0 and divergence.divergence(none).count() == 0


def plain_audit(rows, labels):
    """Result rows by running every order on every document, of rows (doc_id, source, text)."""
    out = []
    fails = []
    for i, source, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        failed += "D" * bool(re.search("[#$%&*|]", text)) + "E" * any(i is not None and j is not None and j < i and (t or "") == text for j, _, t in rows)
        fails.append((source or "", failed, *labels.get(i, (0, 0))))
    for part in sorted({f[0] for f in fails}):
        own = [f for f in fails if f[0] == part]
        removed_by, found = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                again = sum(letter in f[1] for f in own) - len(gone)
                removed_by[letter] += len(gone)
                found.append((part, order, step, len(left), len(gone), again, sum(f[1] == letter for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        out += [(*f, removed_by[f[1][f[2] - 1]]) for f in found]
    return out


def test_filter_audit_on_awkward_rows(spark, documents, no_documents):
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (8, 1, None), (None, 1, 1), (77, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = [(r.doc_id, r.source, r.text) for r in documents.collect()]
    got = filter_audit.interactions(documents, known).collect()
    want = plain_audit(rows, {1: (1, 1), 2: (0, 1), 8: (1, 0)})
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 600 * len({r[1] or "" for r in rows})
    assert filter_audit.interactions(no_documents, known).count() == 0
    assert filter_audit.interactions(documents, known.limit(0)).count() == len(got)


def test_parity_sums_invert_to_cells():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 10**12, (3, 32))
    signs = np.array([[1 - 2 * ((w & m).bit_count() % 2) for m in range(32)] for w in range(32)])
    assert (filter_audit.inverted(cells @ signs.T) == cells).all()
    with pytest.raises(ValueError):
        filter_audit.inverted(np.arange(32)[None])
