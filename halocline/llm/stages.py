"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns documents; the last returns pieces.

`docs` has the columns of the table documents (doc_id, text, lang, source, n_chars) and any others; all but the last
stage return the columns they were given, those others unchanged, whatever their names. Every stage gives defined
results for awkward rows, those of its operator:

* drop_toxic: null and empty texts score 0 and stay; repeated rows are judged each; without labels all rows stay.
* drop_boilerplate_lines: null texts stay null; a document that would lose more than half of its characters is a copy
  rather than a page with boilerplate, and stays whole for the next stage.
* drop_near_duplicates: rows without words and rows with a null doc_id stay; rows repeated with one doc_id stay or go together.
* mix_sources: a null language or source is a leaf of its own; rows of leaves without words go.
* pack_sequences: null and empty texts give the end id alone; repeated rows are packed each.

An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, mixing, ngram_join, packing, toxicity
from .common import drop_written, fresh, read_table, written
from .queries import MIX_SEED, MIX_SHARE, TOKENIZERS, WEIGHTS, with_domain


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below one half."""
    labels = read_table(spark, sf_dir, "labels").where(~toxicity.held_out())
    name = fresh(docs.columns, "toxicity")
    out = toxicity.scored(docs, toxicity.fit(docs, labels), name)
    return out.where(F.col(f"{name}.score") < 0.5).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its source's boilerplate lines where they are no more than half of it; n_chars follows the text."""
    clean = fresh(docs.columns, "clean_text")
    out = line_dedup.drop_boilerplate(docs, F.col("source"), clean=clean, counts=None, most=0.5)
    size = F.when(F.col(clean).isNull(), F.col("n_chars")).otherwise(F.char_length(clean).cast("long"))
    return out.withColumns({"text": F.col(clean), "n_chars": size}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The seeded prefix of every leaf that the budget of half the words gives it, each document once at most and one of
    each leaf cut to the words that are left for it; n_chars follows the text."""
    domain = fresh(docs.columns, "domain")
    levels = {domain: WEIGHTS["domain"], "lang": WEIGHTS["lang"], "source": WEIGHTS["source"]}
    out = mixing.mixed(with_domain(docs, domain), share=MIX_SHARE, weights=levels, max_epochs=1, seed=MIX_SEED, levels=tuple(levels))
    taken = F.col(out.columns[-1])
    cut = mixing.words(F.col("text")) > taken
    text = F.when(cut, mixing.first_words(F.col("text"), taken)).otherwise(F.col("text"))
    size = F.when(cut, F.char_length(text).cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumns({"text": text, "n_chars": size}).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, one sequence each."""
    return packing.pack(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from the table documents on, each written to the shared folder; a stage's rows go when the next are written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = written(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            drop_written(docs)
        docs = done
    return docs
