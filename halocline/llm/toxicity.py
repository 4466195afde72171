"""Toxicity by multiple-instance learning.

Only documents are labelled, yet it is sentences that offend. Each sentence's probability is a logistic function of the
words and word beginnings in it; a document's is their noisy-or, 1 - prod(1 - p), relative to as many sentences without
any telling word, so that those add nothing and a text doesn't turn toxic by its length. The weights and the bias are fitted
to the labels of documents through the noisy-or, so the gradient finds the sentences responsible. Clean documents joined
are a clean document too, so that groups of JOINED of them are fitted on as well, against weak evidence that adds up.
Weights are kept at zero or above: a word can speak for an offence, not against one. Sentence probabilities then locate
the offending sentences.

Weak evidence (sentences below SURE) counts only as far as it exceeds what clean text of as many sentences holds: the mean a
sentence of the clean documents fitted on. Clean text of any length therefore scores near 0, and a sure sentence in it
counts in full.

Fitting uses at most `sample` labelled documents, half of each label (the documented bound); their features are counted
and encoded by Spark jobs, and all that are commoner in toxic documents reach the driver, with the encoded sample.

Defined results: null or empty text has no sentence and scores 0; sentences of any
number are scored one by one, those without a telling word add nothing; without labels every text scores 0; repeated
labels of one document count as toxic if any is; null labels are left out; repeated rows are scored each; columns of
`docs` other than text pass through untouched, and a result column whose name is taken gets underscores before it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, fresh, small_batches, written

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W\d_]+")
BEGINNING = 4  # letters of a word beginning; written with a star behind
SAMPLE, LEAST, JOINED = 8_000, 4, 16
SURE = 0.6  # sentence probability from which evidence counts in full
SCORED = "score double, n_sentences int, n_offending int, worst_score double, worst_start int, worst_end int"


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]  # words, and beginnings with a star behind
    usual: float = 0.0  # weak evidence of a sentence of clean text, as -log(1 - p) above that of a silent one


def features(text: str) -> list[str]:
    """Every word once, and the beginning of every such word: as often as there are words with it."""
    words = set(WORD.findall(text.lower()))
    return [*words, *(w[:BEGINNING] + "*" for w in words if len(w) >= BEGINNING)]


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text)]


def score_text(text: str, model: Model) -> tuple[float, int, int, float, int, int]:
    """Document score, sentences, sentences of 0.5 or more, and the score and span of the worst."""
    spans = sentences(text)
    none = 1 / (1 + np.exp(-model.bias))
    weights = model.weights
    sure, weak, offending, worst = 0.0, 0.0, 0, (0.0, *(spans[0] if spans else (0, 0)))
    if any(f in weights for f in features(text)):
        for start, end in spans:
            z = sum(weights[f] for f in features(text[start:end]) if f in weights)
            if z:
                p = min(1 / (1 + np.exp(-model.bias - z)), 1 - 1e-12)
                evidence = np.log1p(-none) - np.log1p(-p)
                sure, weak = (sure + evidence, weak) if p >= SURE else (sure, weak + evidence)
                offending += p >= 0.5
                if p > worst[0]:
                    worst = p, start, end
    clean = sure + max(0.0, weak - model.usual * len(spans))
    return max(0.0, float(-np.expm1(-clean))), len(spans), offending, float(worst[0]), worst[1], worst[2]


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "toxic") -> DataFrame:
    """(text, label) of at most `sample` labelled documents, half of each label, chosen by a hash of doc_id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("at", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("y") == y).orderBy("at", "doc_id").limit(sample // 2) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select("doc_id", "y")
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("text", "y")  # at most `sample` ids


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "toxic", steps: int = 400) -> Model:
    """Fit the weights to the labels through the noisy-or."""
    small_batches(docs.sparkSession)
    rows = written(training_sample(docs, labels, sample, label), "toxicity-sample")

    @F.pandas_udf("array<string>")
    def seen(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(set(features(t))))

    totals = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda y: F.sum((F.col("y") == y).cast("long")) / F.lit(float(max(1, totals.get(y, 0))))
    counted = rows.select("y", F.explode(seen("text")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), share(1).alias("toxic"), share(0).alias("clean"))
    telling = counted.where(f"n >= {LEAST} and toxic > 3 * clean")
    names = sorted(r.f for r in telling.select("f").collect())
    place = {f: i for i, f in enumerate(names)}

    @F.pandas_udf("n int, found array<array<int>>")
    def encoded(texts: pd.Series) -> pd.DataFrame:
        sizes, out = [], []
        for t in texts:
            found = [[place[f] for f in features(t[s:e]) if f in place] for s, e in sentences(t)]
            sizes.append(len(found))
            out.append([sorted(x) for x in found if x])
        return pd.DataFrame({"n": sizes, "found": out})

    bags = rows.select("y", encoded("text").alias("x")).select("y", "x.n", "x.found").toPandas() if names else pd.DataFrame({"y": [], "n": [], "found": []})
    drop_written(rows)
    return _fitted(bags, names, steps)


def _fitted(bags: pd.DataFrame, names: list[str], steps: int, bias: float = -6.0, most: float = -3.0, rate: float = 0.1, penalty: float = 0.0007, joined: float = 0.1) -> Model:
    """Adam on the weighted log-likelihood of the documents; both labels weigh one half in total, and groups of clean
    documents have `joined` of that of the clean ones' half.

    The bias stays at `most` or below. The penalty on the sum of the weights drops features that speak for a few documents of many only."""
    if not names or not len(bags):
        return Model(bias, {})
    found, y, own = [list(x) for x in bags["found"]], bags["y"].to_numpy(float), len(bags)
    clean = [x for x, label in zip(found, y, strict=True) if not label]
    groups = [[s for x in clean[i : i + JOINED] for s in x] for i in range(0, len(clean), JOINED)]
    weight = np.concatenate([np.where(y == 1, 0.5 / max(1, y.sum()), (0.5 - joined) / max(1, len(clean))), np.full(len(groups), joined / max(1, len(groups)))])
    found, y = found + groups, np.concatenate([y, np.zeros(len(groups))])
    of_doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
    sizes = np.array([len(s) for x in found for s in x], np.int64)
    cols = np.concatenate([np.asarray(s, np.int64) for x in found for s in x]) if len(sizes) else np.empty(0, np.int64)
    of_sentence = np.repeat(np.arange(len(sizes)), sizes)
    now = np.append(np.full(len(names), 0.5), bias)  # the weights, then the bias
    least, upper = np.append(np.zeros(len(names)), -np.inf), np.append(np.full(len(names), np.inf), most)
    m, v = np.zeros(len(now)), np.zeros(len(now))
    for step in range(1, steps + 1):
        bias, z = now[-1], now[-1] + np.bincount(of_sentence, now[cols], len(sizes))
        log_none = np.logaddexp(0, bias) - np.logaddexp(0, z)  # log(1 - p), less that of a sentence without features
        p_doc = np.clip(-np.expm1(np.bincount(of_doc, log_none, len(found))), 1e-9, 1 - 1e-9)
        # d loss / d log(1 - p_doc): toxic documents want it low, clean ones high.
        slope = (weight * np.where(y == 1, (1 - p_doc) / p_doc, -1.0))[of_doc]
        p, none = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        grad = np.append(np.bincount(cols, -(slope * p)[of_sentence], len(names)) + penalty, (slope * (none - p)).sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        now = np.clip(now - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8), least, upper)
    weights = np.where(now[:-1] > 0.05, now[:-1], 0.0)
    z = now[-1] + np.bincount(of_sentence, weights[cols], len(sizes))
    weak = (1 / (1 + np.exp(-z)) < SURE) & (of_doc < own) & (y[of_doc] == 0)
    evidence = np.where(weak, np.logaddexp(0, z) - np.logaddexp(0, now[-1]), 0.0).sum()
    usual = evidence / max(1, bags["n"].to_numpy()[y[:own] == 0].sum())
    return Model(float(now[-1]), {f: float(x) for f, x in zip(names, weights, strict=True) if x}, float(usual))


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """`docs` with one struct column more (SCORED)."""

    @F.pandas_udf(SCORED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([score_text(t or "", model) for t in texts], columns=[x.split()[0] for x in SCORED.split(", ")])

    small_batches(docs.sparkSession)
    return docs.withColumn(fresh(docs.columns, name), run(F.col("text").cast("string")))


def held_out():
    """Whether a row's labels are kept from fitting: crc32 of doc_id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
