"""The corpus pipeline: every stage against its plain version, on the sample table and on awkward rows."""

import re
import zlib
from collections import defaultdict

import brute
import duckdb
import numpy as np
import pytest

import corpus_pipeline
from halocline.llm import line_dedup, queries, stages, toxicity
from halocline.llm.common import written


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in rows)


def test_every_stage_matches_its_plain_version(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, before = docs.columns, docs.collect()
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    assert model.weights
    found = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        after = docs.collect()
        if name == "toxicity":
            want = [r for r in before if brute.noisy_or(r.text, model.bias, model.weights, model.usual) < 0.5]
        elif name == "line_dedup":
            text = brute.without_boilerplate([(r.doc_id, r.text, r.source) for r in before], line_dedup.RATIO, line_dedup.LEAST, 0.5)
            want = [(r.doc_id, text[r.doc_id], r.lang, r.source, len(text[r.doc_id] or "")) for r in before]
        elif name == "ngram_jaccard_join":
            component = brute.components([(r.doc_id, r.text) for r in before])
            want = [r for r in before if component[r.doc_id][1] == r.doc_id]
        else:
            leaf = lambda r: ("web" if r.source in {f"src{k}" for k in range(10)} else "library", r.lang, r.source)
            taken = brute.mixed([(r.doc_id, r.text, leaf(r)) for r in before], queries.MIX_SHARE, list(queries.WEIGHTS.values()), queries.MIX_SEED)
            words = {r.doc_id: re.findall(r"[^ \t\n\x0b\f\r]+", r.text or "") for r in before}
            want = []
            for r in (r for r in before if r.doc_id in taken):
                k = taken[r.doc_id][0]
                text = r.text if k == len(words[r.doc_id]) else re.match(rf"[ \t\n\x0b\f\r]*(?:[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]+){{{k - 1}}}[^ \t\n\x0b\f\r]+", r.text)[0]
                want.append((r.doc_id, text, r.lang, r.source, r.n_chars if text == r.text else len(text)))
            assert sum(t[0] for t in taken.values()) >= 0.99 * (sum(map(len, words.values())) // 2)
        assert sorted(map(tuple, after)) == sorted(map(tuple, want)), name
        found.append(len(after))
        before = after
    assert 200 > found[0] == found[1] > found[2] > found[3] > 0
    tokenizer = Tokenizer.from_file(f"{queries.TOKENIZERS}/word_bpe_49k.json")
    pieces = defaultdict(list)
    run = corpus_pipeline.run(spark, sf).collect()
    for p in run:
        pieces[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    assert set(pieces) == {r.doc_id for r in before} and len({p.sequence_id for p in run}) == len(run)
    for r in before:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for start, length, crc, n in sorted(pieces[r.doc_id]):
            assert start == at and n == len(ids) and length & (length - 1) == 0 and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)


def test_stages_on_awkward_rows(spark, documents, no_documents, sf):
    """Columns with the operators' own names pass through; nulls, empties and repeats have the results of the docstring."""
    before = {c: documents.first()[c] for c in documents.columns[5:]}
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=lambda i: (i is not None, i))
    docs = documents
    got = {}
    for name, stage in stages.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == documents.columns, name
        assert all({c: r[c] for c in before} == before for r in docs.collect()), name
        got[name] = ids(docs)
    assert got["toxicity"] == got["line_dedup"] == ids(documents)
    assert got["ngram_jaccard_join"] == [None, 1, 3, 4, 5, 6, 8, 9]
    leaf = lambda r: ("web" if r.source in {f"src{k}" for k in range(10)} else "library", r.lang, r.source)
    left = [r for r in documents.dropDuplicates(["doc_id"]).collect() if r.doc_id in got["ngram_jaccard_join"]]
    name_of = lambda r: "null" if r.doc_id is None else r.doc_id
    taken = brute.mixed([(name_of(r), r.text, leaf(r)) for r in left], queries.MIX_SHARE, list(queries.WEIGHTS.values()), queries.MIX_SEED)
    assert sorted(map(str, taken)) == sorted("null" if i is None else str(i) for i in got["mixing"]) and 3 not in got["mixing"]
    pieces = stages.pack_sequences(spark, documents, sf).collect()
    assert [(p.length, p.doc_tokens) for p in pieces if p.doc_id in (3, 4)] == [(1, 1), (1, 1)] and any(p.doc_id is None for p in pieces)
    docs = no_documents
    for name, stage in stages.STAGES:
        docs = written(stage(spark, docs, sf), name)
        assert docs.count() == 0, name


def test_one_text_of_every_copied_group_stays(spark, sf):
    """Copies on more than a hundredth of a source have lines as frequent as boilerplate, but one of them has to survive."""
    copied = "A line that is long enough to be copied.\nAnother one follows it here.\nAnd a third, to end with."
    rows = [(k, copied if k % 50 == 7 else f"Own text number {k} with words {k * k} {k * 7} {k * 11} of its own.\nFooter", "en", "s", 9) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in stages.STAGES[1:3]:
        docs = written(stage(spark, docs, sf), name)
    left = {r.doc_id: r.text for r in docs.collect()}
    assert left[7] == copied and [t for t in left.values()].count(copied) == 1
    assert len(left) == 295 and not any("Footer" in t or not t for t in left.values())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = queries.queries()[name](spark, sf)
    got = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in got.description]
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(cols, got.fetchall())
