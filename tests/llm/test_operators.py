"""The ten operators against brute force, round trips and held-out accuracy, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.llm import chat_format, exact_dedup, fingerprints, line_dedup, mixing, ngram_join, packing, pii, queries, token_counts, toxicity
from halocline.llm.queries import TOKENIZERS

BPE = f"{TOKENIZERS}/word_bpe_49k.json"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


# --- toxicity -----------------------------------------------------------------------------------------------------


def test_toxicity_finds_held_out_documents(spark):
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_locates_the_sentence(spark, documents, no_documents):
    rows = [(k, f"A calm line {k}. {'You utter scoundrel. ' if k % 2 else ''}More calm words follow here.") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(3, 0), (5, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    for r in toxicity.scored(docs, model, "t").collect():
        assert (r.t.score >= 0.5) == (r.doc_id % 2 == 1)
        if r.doc_id % 2:
            assert r.text[r.t.worst_start : r.t.worst_end].strip() == "You utter scoundrel."
    out = toxicity.scored(documents, model, "t")
    assert out.count() == documents.count() and set(documents.columns) < set(out.columns)
    assert {(r["t"], r["_t"].score) for r in out.where("text is null or text = ''").collect()} == {("own t", 0.0)}
    assert toxicity.scored(no_documents, model).count() == 0
    assert toxicity.fit(no_documents, labels).weights == {}
    assert toxicity.fit(documents, labels.limit(0)).weights == {}


def test_toxicity_query_matches_plain_noisy_or(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    text = texts(spark, sf)
    rows = queries.op1_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text) and model.weights
    for r in rows:
        assert abs(r.score - brute.noisy_or(text[r.doc_id], model.bias, model.weights, model.usual)) < 1e-6


def test_toxicity_fits_the_bias_and_joined_clean_documents(spark):
    """A word in a few clean documents and in many toxic ones mustn't make clean ones toxic by adding up."""
    rows = [(k, f"Calm line {k}. {'Odd word. ' if k % 10 == 0 else ''}Calm.", 0) for k in range(400)]
    rows += [(k, f"Calm. {'Odd word. ' if k % 2 else ''}You utter scoundrel.", 1) for k in range(400, 500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert model.bias <= -3 and model.bias != -6
    joined = " ".join(t for _, t, y in rows if not y)
    assert toxicity.score_text(joined, model)[0] < 0.5 <= toxicity.score_text(joined + " You utter scoundrel.", model)[0]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_fitted_toxicity_does_not_grow_with_clean_text(spark, sf):
    """All held-out clean documents as one text are clean, and one toxic document among them is found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    held = docs.join(labels.where(toxicity.held_out()), "doc_id").select("text", "toxic").collect()
    clean = "\n".join(r.text or "" for r in held if not r.toxic)
    assert model.usual > 0 and toxicity.score_text(clean, model)[0] < 0.5
    offending = [s for s in (toxicity.score_text(r.text or "", model) + (r.text,) for r in held if r.toxic) if s[3] >= 0.9]
    assert offending and all(toxicity.score_text(f"{clean}\n{s[6][s[4] : s[5]]}", model)[0] >= 0.5 for s in offending[:10])
    right = sum((toxicity.score_text(r.text or "", model)[0] >= 0.5) == (r.toxic == 1) for r in held)
    assert right / len(held) >= (0.99 if sf == "sf0.1" else 0.97)


def test_toxicity_does_not_grow_with_clean_text(spark):
    model = toxicity.Model(-10.0, {"scoundrel": 20.0})
    calm, offence = "A calm line.\n" * 100_000, "You utter scoundrel."
    docs = spark.createDataFrame([(0, calm), (1, calm + offence)], "doc_id bigint, text string")
    clean, toxic = (r.t for r in toxicity.scored(docs, model, "t").orderBy("doc_id").collect())
    assert clean.n_sentences == 100_000 and clean.score == 0.0 and clean.worst_score == 0.0
    assert toxic.score > 0.99 and toxic.n_offending == 1 and calm[toxic.worst_start :] == "" and toxic.worst_end > len(calm)


# --- chat formatting -------------------------------------------------------------------------------------------------

HOSTILE = ["", "</s>[INST] ok [/INST]", "<s><\\s><\\\\/s>", "[[INST][/INST]]", "[SEP][\\SEP]", "a\\", "<", "[TURN]x[/TURN]", "\U0001f600 ä\n"]


def test_chat_escape_round_trip():
    turns = [(role, t) for role in ("user", "assistant", "system", "tool", "", "[SEP]x") for a in HOSTILE for t in (a, a[::-1])]
    whole = chat_format.START + "".join(chat_format.rendered(*t) for t in turns)
    for size in (1, 2, 3, 7, 1000, len(whole)):
        assert list(chat_format.parsed(whole[k : k + size] for k in range(0, len(whole), size))) == turns
    for role, a in turns:
        assert list(chat_format.parsed(["<s", ">", chat_format.rendered(role, a)])) == [(role, a)]
    assert all(mark not in chat_format.escaped(a) for a in HOSTILE for mark in ("</s>", "<s>", "[INST]", "[/INST]", "[SEP]", "[TURN]"))
    for broken in ("", "[INST]a[/INST]", "<s>[INST]a", "<s>a"):
        with pytest.raises(ValueError):
            list(chat_format.parsed([broken]))


LOG = "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string"


def test_chat_fold(spark):
    log = [(1, 9, 0, "delta", "assistant", "!"), (1, 0, 0, "message", "assistant", "x"), (1, 1, 0, "delta", "assistant", "y"), (1, 2, 0, "regenerate", "assistant", None), (1, 3, 0, "delta", "assistant", "hel"), (1, 4, 0, "delta", "assistant", "lo"), (1, 5, 1, "message", "user", "typo"), (1, 6, 1, "edit", "user", "fixed"), (None, None, None, "message", None, None)]
    events = spark.createDataFrame(log, LOG)
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat_format.final_messages(events).collect()}
    assert got == {(1, 0): ("assistant", "hello!"), (1, 1): ("user", "fixed"), (None, None): ("", "")}
    assert chat_format.final_messages(events.limit(0)).count() == 0 == chat_format.conversation_digests(chat_format.formatted(events.limit(0))).count()


def test_chat_events_of_turns_interleave(spark):
    edge = (1 << 63) - 1
    log = [(5, 0, 0, "message", "user", "helo"), (5, 1, 1, "message", "assistant", ""), (5, 2, 1, "delta", "assistant", "a"), (5, 3, 2, "message", "user", "more"), (5, 4, 1, "delta", "assistant", "b"), (5, 5, 3, "delta", "assistant", "c"), (5, 6, 0, "edit", "user", "hello")]
    log += [(6, -edge - 1, edge, "message", "user", "last"), (6, edge, -edge - 1, "message", "user", "first"), (6, 0, None, "message", "user", "none")]
    for parts in (1, 7):
        events = spark.createDataFrame(log[::-1], LOG).repartition(parts)
        got = [(r.conv_id, r.turn, r.role, r.text) for r in chat_format.final_messages(events).collect()]
        assert [g[1:] for g in got if g[0] == 5] == [(0, "user", "hello"), (1, "assistant", "ab"), (2, "user", "more"), (3, "assistant", "c")]
        assert [g[3] for g in got if g[0] == 6] == ["none", "first", "last"]
        texts = chat_format.formatted(events, size=5)
        assert max(len(r.formatted) for r in texts.collect()) == 5
        whole = {r.conv_id: r for r in chat_format.conversation_digests(texts.repartition(3)).collect()}
        said = "<s>[INST]hello[/INST]ab</s>[INST]more[/INST]c</s>"
        assert (whole[5].formatted_sha256, whole[5].formatted_chars, whole[5].n_turns) == (hashlib.sha256(said.encode()).hexdigest(), len(said), 4)
        assert (whole[5].loss_chars, whole[5].loss_sha256) == (3, hashlib.sha256(b"abc").hexdigest())


def test_chat_long_conversation_and_text(spark):
    long = "<s>[INST] wort ä\n" * 60_000
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(3000)] + [(2, 0, "user", long), (2, 1, "assistant", long)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.formatted(chat_format.events_of_turns(turns)), in_order=True).collect()}
    assert got[1].n_turns == 3000 and got[1].loss_sha256 == hashlib.sha256("".join(f"turn {k}" for k in range(1, 3000, 2)).encode()).hexdigest()
    assert got[2].loss_chars == len(long) and got[2].turns_sha256 == hashlib.sha256(f"user\n{long}\nassistant\n{long}\n".encode()).hexdigest()


def test_chat_moves_texts_once(spark, sf):
    plan = queries.op2_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_chat_digests_match_brute_force(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, 0, "user", queries.CONTROL), (-7, 1, "assistant", queries.CONTROL)]
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, role or "", text or ""))
    got = {r.conv_id: r for r in queries.op2_chat_format(spark, sf).collect()}
    assert set(got) == set(by)
    for conv, rows in by.items():
        rows.sort()
        said = "".join(t for _, r, t in rows if r == "assistant")
        want = (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert tuple(got[conv])[1:5] == want
        assert got[conv].formatted_chars == len("<s>" + "".join(chat_format.rendered(r, t) for _, r, t in rows))


def test_chat_repeated_and_null_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, None), (1, None, "tool", "b"), (None, 0, "user", "c" * 1000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.formatted(chat_format.events_of_turns(turns))).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 4, None: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"tool\nb\n\n\nuser\na\nuser\na\n").hexdigest()
    assert chat_format.events_of_turns(turns.limit(0)).count() == 0


# --- line dedup --------------------------------------------------------------------------------------------------------


def test_line_dedup(spark, documents, no_documents):
    rows = [(k, f"own line {k}\n Menu | Home \nshared by {k // 4}\n\nMenu | Home", "a" if k % 3 else None) for k in range(40)] + [(99, "Menu | Home", "b"), (100, "Menu | Home", "b"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, F.col("source"), least=4).collect()}
    for k in range(40):
        assert got[k].clean_text == f"own line {k}\nshared by {k // 4}\n" and (got[k].n_lines, got[k].n_dropped) == (5, 2)
    assert got[99].clean_text == "Menu | Home" and got[None].clean_text is None
    everything = line_dedup.drop_boilerplate(docs.where("doc_id >= 99"), F.col("source"), least=1, ratio=0.5)
    assert {r.doc_id: r.clean_text for r in everything.collect()} == {99: "", 100: ""}
    out = line_dedup.drop_boilerplate(documents, F.col("source"))
    assert out.count() == documents.count() and set(documents.columns) < set(out.columns)
    assert line_dedup.drop_boilerplate(no_documents, F.col("source")).count() == 0
    urls = spark.createDataFrame([("http://A.example.com/x?q=1",), ("no url",), (None,)], "url string")
    assert [r[0] for r in urls.select(line_dedup.host_of_url(F.col("url"))).collect()] == ["a.example.com", None, None]


def test_line_dedup_drops_lines_on_a_few_hundredths_of_a_host(spark):
    lines = lambda k: [f"own line {k}", *["on one in twenty"] * (k % 20 == 0), *["on one in fifty"] * (k % 50 == 0), *["on one in a hundred"] * (k % 100 == 0)]
    docs = spark.createDataFrame([(k, "\n".join(lines(k)), "a") for k in range(1000)], "doc_id bigint, text string, source string")
    for r in line_dedup.drop_boilerplate(docs, F.col("source")).collect():
        assert r.clean_text == "\n".join(x for x in lines(r.doc_id) if x in (f"own line {r.doc_id}", "on one in a hundred"))
    # A host's array stays below the mean lines of its documents over the ratio.
    mean = sum(len(lines(k)) for k in range(1000)) / 1000
    assert [len(r.lines) < mean / line_dedup.RATIO for r in line_dedup.boilerplate(docs, F.col("source")).collect()] == [True]


# --- exact dedup -------------------------------------------------------------------------------------------------------


def brute_exact(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(lower)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, documents, tmp_path, weak):
    documents.repartition(4).write.parquet(str(tmp_path / "d"))
    # A weak digest has hits between different texts; the byte check must part them. One file a batch tests the state.
    digest = (lambda c: F.substring(exact_dedup.sha256(c), 1, 0)) if weak else exact_dedup.sha256
    got = exact_dedup.exact_duplicates(spark, str(tmp_path / "d"), digest, files_per_batch=1)
    want = brute_exact([(r.doc_id, r.text) for r in documents.collect()])
    assert Counter(tuple(r)[:5] for r in got.collect()) == want


def test_exact_dedup_locator_and_empty(spark, documents, no_documents, tmp_path):
    no_documents.write.parquet(str(tmp_path / "none"))
    assert exact_dedup.exact_duplicates(spark, str(tmp_path / "none")).count() == 0
    documents.coalesce(1).write.parquet(str(tmp_path / "d"))
    state = exact_dedup.digest_state(spark, str(tmp_path / "d"))
    at = spark.read.parquet(str(tmp_path / "d")).select("doc_id", F.col("_metadata.file_path").alias("keep_file"), F.col("_metadata.row_index").alias("keep_row"))
    assert state.where("keep_id is not null").join(at, ["keep_file", "keep_row"]).where("doc_id = keep_id").count() == state.where("keep_id is not null").count()


# --- n-gram Jaccard join -------------------------------------------------------------------------------------------------


def test_ngram_join_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    want = brute.components([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and any(c != i for i, (_, c) in want.items())


def test_ngram_join_on_chains_and_large_groups(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):  # a large group around one text, with zero to four words changed
        words = list(base)
        for place in rng.choice(60, int(rng.integers(0, 5)), replace=False):
            words[place] = f"x{rng.integers(0, 40)}"
        rows.append((k, " ".join(words)))
    chain = [f"c{k}" for k in range(100)]
    rows += [(1000 + k, " ".join(chain[k : k + 60])) for k in range(40)]  # each is like its neighbours only
    rows += [(2000 + k, " ".join([*base[:30], *(f"y{k}_{j}" for j in range(30))])) for k in range(60)]  # a common passage
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute.components(rows)


def test_ngram_join_awkward_rows(spark, documents, no_documents):
    rows = ngram_join.near_duplicates(documents).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    want = brute.components([(r.doc_id, r.text) for r in documents.where("doc_id is not null").collect()])
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None][1] is None and len(rows) == documents.count()
    assert ngram_join.near_duplicates(no_documents).count() == 0
    left = ngram_join.without_near_duplicates(documents)
    assert left.columns == documents.columns and {r.doc_id for r in left.collect()} == {1, 3, 4, 5, 6, 8, 9, None}


def test_filters_never_lose_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, int(rng.integers(0, 8))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        alike = 100 * shared >= 80 * (len(a) + len(b) - shared)
        assert ngram_join.similar(a, b) == alike
        for order in ngram_join.ORDERS if alike else ():
            short = [ngram_join.in_order(s, order, ngram_join.prefix_length(len(s))) for s in (a, b)]
            assert len(np.intersect1d(*short))
            longer = [ngram_join.in_order(s, order, ngram_join.prefix_length(len(s), common=ngram_join.spare(len(s)))) for s in (a, b)]
            met = len(np.intersect1d(*longer))
            assert all(met >= ngram_join.needed(len(s)) for s in (a, b))


def test_filters_are_intersected_before_texts_meet(spark):
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join([f"x{k}_{i}" if rng.random() < k / 300 else w for i, w in enumerate(base)]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    keyed = ngram_join.with_text(docs, ngram_join.classes(ngram_join.profiles(docs)))
    sets = {r.key: ngram_join.shingles(r.text) for r in keyed.collect()}
    every = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a bigint, b bigint")
    prefixes = ngram_join.prefixes(keyed, 5, 80)
    got = {tuple(r) for r in ngram_join.sharing(every, prefixes).collect()}
    meets = lambda a, b, order: len(np.intersect1d(*(ngram_join.in_order(sets[k], order, ngram_join.prefix_length(len(sets[k]))) for k in (a, b)))) > 0
    pairs = [(a, b) for a in sets for b in sets if a < b]
    by_order = [{p for p in pairs if meets(*p, order)} for order in ngram_join.ORDERS]
    assert got == by_order[0] & by_order[1] and got < by_order[0] and got < by_order[1]
    assert {(a, b) for a, b in pairs if ngram_join.similar(sets[a], sets[b])} <= got


def test_classes_are_told_apart_by_whole_digests(spark, monkeypatch):
    """Digests that agree in their first half are different sets; rows of one doc_id with several texts stay apart."""
    digest = ngram_join.set_digest
    assert len(digest(ngram_join.shingles("a b c d e f"))) == 16
    monkeypatch.setattr(ngram_join, "set_digest", lambda tokens: b"8 bytes." + digest(tokens)[8:])
    rows = [(k, " ".join(f"{'v' if k % 2 else 'w'}{k // 4}_{j}" for j in range(30))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    reps = ngram_join.classes(ngram_join.profiles(docs))
    assert reps.count() == 20 and reps.select("key").distinct().count() == 20
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()} == brute.components(rows)
    monkeypatch.undo()
    twice = spark.createDataFrame([(5, rows[0][1]), (5, rows[1][1]), (6, rows[0][1] + " more"), (7, rows[1][1] + " more"), (8, rows[8][1])], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(twice).collect()} == {(5, 5), (6, 5), (7, 5), (8, 8)}


def test_ngram_join_of_a_group_without_a_centre(spark, monkeypatch):
    """Sets of one group of which each is similar to some others only: few pairs are left for the last step."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        gone = set(rng.choice(16, 3, replace=False).tolist())
        rows.append((k, " ".join("x" if j % 7 == 3 and j // 7 in gone else w for j, w in enumerate(base)) + f" end{k}"))
    counts, verified = [], ngram_join.verified

    def counted(pairs, *others):
        counts.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(ngram_join, "verified", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()} == brute.components(rows)
    assert len(set(c for _, c in brute.components(rows).values())) < 20 and (len(counts) < 5 or counts[-1] < 150 * 149 / 8)


def test_frequent_tokens_are_dealt_by_set(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "EVERY", 1)
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(k, f"{base} {' '.join(f'y{k}_{j}' for j in range(k % 13))} z{k}") for k in range(60)] + [(100 + k, f"{base} {k}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    reps = ngram_join.classes(ngram_join.profiles(docs))
    shared = ngram_join.shared_tokens(ngram_join.with_text(docs, reps), reps, 5).cache()
    assert shared.where(F.col("df") == ngram_join.LAST).groupBy("token").count().where("count = 63").count() == 36
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()} == brute.components(rows)


# --- token counts -------------------------------------------------------------------------------------------------------


def test_token_counts_match_the_library(spark, sf):
    from sentencepiece import sentencepiece_model_pb2
    from tokenizers import Tokenizer, models

    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    vocabulary = [("<unk>", min(p.score for p in model.pieces if p.type == 1))] + [(p.piece, p.score) for p in model.pieces if p.type == 1] + [(p.piece, -1e12) for p in model.pieces if p.type == 6]
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    hostile = ["", " ", "  two  spaces   ", "a\nb\tc", "\U0001f600\U0001f600 ok", "▁ mark", "naïve café 梦ゼ", "x" * 500, "the " * 50]
    own = token_counts.load_vocabulary(PIECES)
    for t in hostile + [t[:3000] for t in list(texts(spark, sf).values())[:60]]:
        whole = token_counts.MARK + t.replace(" ", token_counts.MARK) if t else ""
        assert own.count(t) == len(library.encode(whole, add_special_tokens=False).ids), t[:50]


def test_token_counts_of_whole_texts_match_the_library(spark, sf):
    from sentencepiece import sentencepiece_model_pb2
    from tokenizers import Tokenizer, models

    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    least = min(p.score for p in model.pieces if p.type == 1)
    library = Tokenizer(models.Unigram([("<unk>", least), *((p.piece, p.score) for p in model.pieces if p.type == 1), *((p.piece, -1e12) for p in model.pieces if p.type == 6)], 0, True))
    text = texts(spark, sf)
    for r in queries.op6_token_counts(spark, sf).collect():
        whole = "▁" + text[r.doc_id].replace(" ", "▁") if text[r.doc_id] else ""
        assert (r.n_chars, r.n_tokens) == (len(text[r.doc_id]), len(library.encode(whole, add_special_tokens=False).ids)), r.doc_id


def test_token_count_ties_and_edges(spark, documents, no_documents):
    v = token_counts.Vocabulary([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("abab", -4.0)])
    assert v.count_run("ab") == 1 and v.count_run("abab") == 1 and v.count_run("abb") == 2
    assert v.count("zé") == 1 + 1 + 2  # unknown characters count bytes
    assert token_counts.Vocabulary([]).count("ab") == 5  # the mark has three bytes
    crossing = token_counts.Vocabulary([("a▁b", -1.0), ("a", -5.0), ("b", -5.0), ("▁", -5.0)])
    assert not crossing.by_word and crossing.count("a b") == 2
    got = {r.doc_id: (r.n_chars, r.n_tokens) for r in token_counts.token_counts(documents, PIECES).collect()}
    assert got[3] == got[4] == (0, 0) and got[6] == got[7] and got[8][0] > 300_000
    assert token_counts.token_counts(no_documents, PIECES).count() == 0


# --- fingerprints --------------------------------------------------------------------------------------------------------


def brute_syncmers(text, k=fingerprints.K, s=fingerprints.S):
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(points) < k:
        return []
    h = fingerprints._grams(points, s).tolist()
    out = []
    for i in range(len(points) - k + 1):
        inner = h[i : i + k - s + 1]
        if inner.index(min(inner)) in (0, k - s):
            out.append(i)
    return out


def test_syncmers(spark, sf):
    for t in list(texts(spark, sf).values())[:30] + ["aaaa" * 20, "short", "ab" * 40]:
        points = np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64)
        assert fingerprints.syncmers(points)[0].tolist() == brute_syncmers(t)


def test_fingerprints_match_brute_force(spark, sf):
    t = texts(spark, sf)
    ids = sorted(t)
    for got in (queries.op7_fingerprints(spark, sf), fingerprints.fingerprints(spark.read.parquet(f"{sf}/documents.parquet").repartition(7), 3)):
        rows = {r.doc_id: r for r in got.collect()}
        assert sorted(rows) == ids
        for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
            half = len(t[i]) // 2
            new = t[i][: len(t[i]) - half] + t[after][:half]
            own, changed = fingerprints.anchors(t[i]), fingerprints.anchors(new)
            want = (len(t[i]), hashlib.sha256(new.encode()).hexdigest(), fingerprints.shown(own), fingerprints.shown(changed), fingerprints.likeness(own, changed), fingerprints.likeness(own, fingerprints.anchors(t[after])))
            assert tuple(rows[i])[1:] == want
    assert np.mean([r.near_edited for r in rows.values()]) > 0.4 > 0.1 > np.mean([r.near_next for r in rows.values()])
    assert fingerprints.likeness(own, own) == 1.0


def test_fingerprints_match_plain_syncmers_and_likeness(spark, sf):
    """Hashes are the library's; choice of anchors, kept ones, positions and likeness are not."""
    inner = lambda x: int(fingerprints._grams(np.frombuffer(x.encode("utf-32-le"), "<u4").astype(np.uint64), len(x))[0])
    whole = lambda x: int(fingerprints.syncmers(np.frombuffer(x.encode("utf-32-le"), "<u4").astype(np.uint64))[1][0])
    own = lambda x: inner(x) if len(x) == fingerprints.S else whole(x)
    read = lambda x: [(int(a.split("@")[0], 16), int(a.split("@")[1])) for a in x.split(",") if a]
    t = texts(spark, sf)
    rows = {r.doc_id: r for r in queries.op7_fingerprints(spark, sf).collect()}
    ids = sorted(t)
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        if 16 <= len(t[i]) <= 1500:
            assert read(rows[i].fingerprint) == (brute.anchors(t[i], own, fingerprints.K, fingerprints.S) or read(rows[i].fingerprint))
        assert rows[i].near_edited == brute.likeness(read(rows[i].fingerprint), read(rows[i].edited_fingerprint))
        assert rows[i].near_next == brute.likeness(read(rows[i].fingerprint), read(rows[after].fingerprint))


def test_likeness_bears_spread_edits():
    rng = np.random.default_rng(2)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    text = letters(6000)
    parts = [text[k : k + 600] for k in range(0, 6000, 600)]
    own = fingerprints.anchors(text)
    grown, shrunk = "".join(p + letters(10) for p in parts), "".join(p[:-10] for p in parts)
    half = "".join(p[:300] + letters(300) for p in parts)
    for other in (grown, shrunk):
        assert fingerprints.likeness(own, fingerprints.anchors(other)) > 0.8
    assert 0.3 < fingerprints.likeness(own, fingerprints.anchors(half)) < 0.7
    assert fingerprints.likeness(own, fingerprints.anchors("".join(parts[::-1]))) < 0.4  # in another order
    for _ in range(200):
        places = rng.integers(0, 12, int(rng.integers(0, 9))).tolist()
        best = [0] * len(places)
        for k, p in enumerate(places):
            best[k] = 1 + max((best[j] for j in range(k) if places[j] < p), default=0)
        assert fingerprints.longest_rise(places) == max(best, default=0)


def test_fingerprint_edges(spark, documents, no_documents):
    rows = fingerprints.fingerprints(documents).collect()
    assert len(rows) == documents.count()
    by = {r.doc_id: r for r in rows}
    assert by[3].fingerprint == by[4].fingerprint == "" and by[3].near_next == 1.0 and by[6].fingerprint == by[7].fingerprint != ""
    assert fingerprints.fingerprints(no_documents).count() == 0
    one = fingerprints.fingerprints(documents.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# --- packing -------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    pieces = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), BPE, with_ids=True).collect()
    by = defaultdict(list)
    for p in pieces:
        assert p.length & (p.length - 1) == 0 and p.length <= 4096 and p.offset == 0 and len(p.ids) == p.length
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by[p.doc_id].append(p)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    assert all(len({p.length for p in pieces if p.sequence_id % 13 == b}) <= 1 for b in range(13))
    for i, t in texts(spark, sf).items():
        got = sorted(by[i], key=lambda p: p.start)
        ids = [x for p in got for x in p.ids]
        assert ids == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert [p.start for p in got] == [sum(q.length for q in got[:k]) for k in range(len(got))] and got[0].doc_tokens == len(ids)


def test_words_are_tokenized_as_in_their_text():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    for t in ["It's a TEST. don't, 3.14 x² Σας É̀a <|endoftext|> foo<|endoftext|>bar", "a\x1cb  x y ..., ,., A.B, café. ½ İi ǅ ß.", " nbsp em\u0085nel", "é ö.", "", "\U0001f600.,"]:
        for _ in range(2):
            assert packing.token_ids(t, BPE).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing_keeps_no_long_words():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    words = packing._Words(BPE)
    long = ["a" * 65 + ".", "Ab1" * 300_000, "wort" * 100_000, "x" * 64]
    text = " ".join([*long, "short", *long, "words."])
    for _ in range(2):
        assert np.frombuffer(words.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert "short" in words.known and max(map(len, words.known)) == packing.LONGEST


def test_packing_edges(spark, documents, no_documents):
    assert packing.piece_lengths(4096 * 2 + 5) == [4096, 4096, 4, 1] and packing.piece_lengths(1) == [1]
    rows = packing.pack(documents, BPE).collect()
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id in (3, 4)] == [(1, 1), (1, 1)]
    assert sum(r.length for r in rows if r.doc_id == 8) > 60_000 and sum(r.doc_id == 7 for r in rows) == 2 * sum(r.doc_id == 6 for r in rows)
    assert packing.pack(no_documents, BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(documents, BPE, longest=1000)


# --- PII -------------------------------------------------------------------------------------------------------------------

def test_token_counts_keep_no_long_words():
    vocabulary = token_counts.Vocabulary([("\u2581", -1.0), ("a", -2.0), ("ab", -2.5), ("\u2581ab", -3.0)])
    long = "ab" * 2_500_000
    assert vocabulary.count(f"ab {long} ab a{'b' * 70} a{'b' * 70}") == vocabulary.count("ab") * 2 + vocabulary.count(long) + 2 * vocabulary.count(f"a{'b' * 70}")
    assert max(map(len, vocabulary.known)) <= token_counts.LONGEST


def test_pii_base_matches_patterns(spark, sf):
    rng = np.random.default_rng(3)
    alphabet = list("01239.+-@() ax.%") + ["1.2.3.4", "256", "a@b.c", "4111 1111 1111 1111", "+1 (743) 555-3824", "\U0001f600"]
    samples = ["".join(rng.choice(alphabet, int(rng.integers(1, 60)))) for _ in range(4000)] + list(texts(spark, sf).values())
    for t in samples:
        spans = pii.find_spans(t)
        assert [s for s in spans if s[0] in pii.BASE] == brute.base_spans(t), t
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_pii_query_matches_patterns(spark, sf):
    text = texts(spark, sf)
    rows = queries.op9_pii(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        base = brute.base_spans(text[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert r.n_spans == len([x for x in r.spans.split(",") if x]) and {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))


def test_pii_addresses_of_any_length():
    for size in (3, 70, 90, 5000):
        t = f"at 12 {'A' * size} Long Street, 7 {'b' * size} Street"
        assert [t[s:e] for k, s, e in pii.find_spans(t) if k == "address"] == [f"12 {'A' * size} Long Street"]
    for t in ("x12 Oak Street", "123456 Oak Street", "1 A B C D Street", " Street", "12 Street", "12  Oak Street"):
        assert not [s for s in pii.find_spans(t) if s[0] == "address"], t


def iban(country, rng):
    """A valid account number of a country, by trying check digits."""
    body = "".join(rng.choice(list("0123456789ABCXYZ"), pii.IBAN_LENGTHS[country] - 4))
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    return next(f"{country}{k:02d}{body}" for k in range(98) if number(f"{body}{country}{k:02d}") % 97 == 1)


def test_pii_accounts_of_every_country_whatever_follows():
    rng = np.random.default_rng(9)
    for country in pii.IBAN_LENGTHS:
        own = iban(country, rng)
        for shown in (own, " ".join(own[k : k + 4] for k in range(0, len(own), 4))):
            for before in ("IBAN ", "iban: ", "Iban:"):
                for behind in ("", " 99", " OK now", ".", ", x", "\n7"):
                    t = f"ä {before}{shown}{behind}"
                    assert [t[s:e] for k, s, e in pii.find_spans(t) if k == "account"] == [shown], t
        wrong = own[:-1] + ("1" if own[-1] != "1" else "2")
        for t in (f"IBAN {wrong}", f"IBAN {own}7", f"IBAN {own[:-1]}", f"{own}"):
            assert not [s for s in pii.find_spans(t) if s[0] == "account"], t


def test_pii_cues_in_four_languages():
    found = {
        "er wohnt in der Hauptstrasse 12 dort": "Hauptstrasse 12", "Am Marktplatz 5b, Ulm": "Marktplatz 5b", "Bahnhofstr. 7": "Bahnhofstr. 7", "au rue 5": "rue 5",
        "12 Main St.": "12 Main St.", "12 rue de la Paix, Paris": "12 rue de la Paix", "calle del Sol 44": "calle del Sol 44", "Avenida Reina Sofía, 3": "Avenida Reina Sofía, 3",
    }
    for t, want in found.items():
        assert [t[s:e] for k, s, e in pii.find_spans(t) if k == "address"] == [want], t
    for t in ("hauptstrasse 12", "die Strasse", "la rue verte", "true 5", "calle abajo"):
        assert not [s for s in pii.find_spans(t) if s[0] == "address"], t
    said = {"password is hunter2hunter2hunter2": "hunter2hunter2hunter2", "das Passwort lautet abc12345x": "abc12345x", "mot de passe est zz99zz99": "zz99zz99", "la contraseña es k3k3k3k3k3": "k3k3k3k3k3"}
    for t, want in said.items():
        assert [t[s:e] for k, s, e in pii.find_spans(t) if k == "secret"] == [want], t
    assert not [s for s in pii.find_spans("the secret is outstanding and the token is 123456789") if s[0] == "secret"]


def test_pii_urls_match_a_pattern(spark, sf):
    plain = re.compile(r"(?:https?|ftp)://[^\s<>\"']*[^\s<>\"'.,;:!?)\]}]")
    for t in texts(spark, sf).values():
        assert [(s, e) for k, s, e in pii.find_spans(t) if k == "url"] == [m.span() for m in plain.finditer(t)]


def test_pii_further_kinds_and_edges(spark, documents, no_documents):
    t = "see https://x.example.com/a?b=1. IBAN: GB82 WEST 1234 5698 7654 32, iban GB00WEST12345698765432; api_key = 'abcdefghijklmnop1234' at 12 Long Oak Street today"
    got = {k: t[s:e] for k, s, e in pii.find_spans(t) if k not in pii.BASE}
    assert got == {"url": "https://x.example.com/a?b=1", "account": "GB82 WEST 1234 5698 7654 32", "secret": "abcdefghijklmnop1234", "address": "12 Long Oak Street"}
    rows = {r.doc_id: r for r in pii.personal_data(documents).collect()}
    assert (rows[9].n_email, rows[9].n_ip, rows[9].n_card, rows[9].n_phone) == (1, 1, 1, 1)
    assert rows[4].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[4].spans == ""
    assert pii.personal_data(no_documents).count() == 0


# --- mixing -----------------------------------------------------------------------------------------------------------------


def test_budgets_redistribute_among_siblings_first(spark):
    leaves = [("a", "en", "s1", 100), ("a", "en", "s2", 10), ("a", "de", "s1", 5), ("b", "en", "s1", 1000), ("b", None, "s9", 0)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    weights = {"domain": {"a": 3, "b": 1}, "lang": {"en": 1, "de": 1}}
    for budget in (0, 1, 40, 100, 160, 400, 5000):
        got = {(r.domain, r.lang, r.source): int(r.budget) for r in mixing.leaf_budgets(df, budget, weights, 1).collect()}
        dom = brute.fill(budget, {"a": (3, 115), "b": (1, 1000)})
        lang = brute.fill(dom["a"], {"de": (1, 5), "en": (1, 110)})
        src = brute.fill(lang["en"], {"s1": (1, 100), "s2": (1, 10)})
        assert got == {("a", "en", "s1"): src["s1"], ("a", "en", "s2"): src["s2"], ("a", "de", "s1"): lang["de"], ("b", "en", "s1"): dom["b"]}


def test_mixing_takes_prefixes_of_epochs(spark, documents, no_documents):
    rows = [(k, "w " * (1 + k % 7), "en" if k % 2 else "de", f"src{k % 3}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("domain", F.lit("d"))
    out = mixing.mixed(docs, share=1.4, weights={"source": {"src0": 5}}, max_epochs=3, seed=4).collect()
    budgets = {(r.lang, r.source): int(r.budget) for r in mixing.leaf_budgets(docs.groupBy("domain", "lang", "source").agg(F.sum(mixing.words(F.col("text"))).alias("tokens")), int(sum(1 + k % 7 for k in range(600)) * 1.4), {"source": {"src0": 5}}, 3).collect()}
    for leaf, budget in budgets.items():
        own = [(k, 1 + k % 7) for k, _, lang, source in rows if (lang, source) == leaf]
        whole, part = divmod(budget, sum(t for _, t in own))
        want = Counter((k, t) for k, t in own for _ in range(whole))
        for k, t in sorted(own, key=lambda x: hashlib.md5(f"4:{whole}:{x[0]}".encode()).hexdigest()):
            want[k, min(t, part)] += part > 0
            if t > part:
                break
            part -= t
        own = [r for r in out if (r.lang, r.source) == leaf]
        assert Counter((r.doc_id, r.mix_tokens) for r in own) == +want and sum(r.mix_tokens for r in own) == budget
    again = mixing.mixed(docs.repartition(5), share=1.4, weights={"source": {"src0": 5}}, max_epochs=3, seed=4).collect()
    assert sorted((r.doc_id, r.mix_epoch) for r in again) == sorted((r.doc_id, r.mix_epoch) for r in out)
    awkward = queries.with_domain(documents)
    everything = mixing.mixed(awkward, share=1.0, max_epochs=1)
    assert everything.where("_mix_tokens > 0 and mix_tokens = 'own mix_tokens'").count() == awkward.where(mixing.words(F.col("text")) > 0).count()
    assert set(awkward.columns) < set(everything.columns)
    assert mixing.mixed(queries.with_domain(no_documents)).count() == 0
