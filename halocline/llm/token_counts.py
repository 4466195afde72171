"""Token counts of a unigram tokenizer without building its pieces.

An Aho-Corasick automaton over the vocabulary enumerates, for every end position, the pieces that end there. Dynamic
programming carries only two numbers per position: the best score and the number of pieces of the path that has it.
Ties follow the tokenizer: positions are reached from the earliest start first and a later equal score doesn't replace
the earlier one. Where no single character piece starts, an unknown piece of one character is offered at the lowest
score of the vocabulary less ten; an unknown character counts as its UTF-8 bytes.

Scores are held as doubles; those of the vocabulary file used here are whole numbers, so sums are exact.
No piece holds a word mark behind another character, so a path can be cut before every run of word marks: texts go
word by word with a memory of the counts. A vocabulary without that property goes text by text.

Defined results: null or empty text has 0 tokens; repeated rows are counted each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"  # stands for a space; one is put before every text
UNKNOWN_PENALTY = 10.0
REMEMBERED, LONGEST = 400_000, 64  # words whose counts are kept, and the characters of those that are
RUN = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def utf8_length(char: str) -> int:
    return len(char.encode("utf-8", "surrogatepass"))


class Vocabulary:
    """Pieces and scores, their automaton, and whether words can be counted one by one."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.scores = dict(reversed(pieces))  # the first of equal pieces holds
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if self.scores:
            self.automaton.make_automaton()
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.scores)
        self.known: dict[str, int] = {}

    def count_run(self, text: str) -> int:
        """Pieces of the best path over `text`, whose spaces are marks already."""
        n, unknown = len(text), self.unknown
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        done, end, best, pieces, single = 0, -1, 0.0, 0, True  # `done` positions are settled, `end` is being settled

        def settle(upto: int) -> None:
            """Close the open position; characters without any piece before `upto` are unknown ones."""
            nonlocal done
            if done <= end:
                if not single and score[end] + unknown > best:
                    score[end + 1], count[end + 1] = score[end] + unknown, count[end] + utf8_length(text[end])
                else:
                    score[end + 1], count[end + 1] = best, pieces
                done = end + 1
            while done < upto:
                score[done + 1], count[done + 1] = score[done] + unknown, count[done] + utf8_length(text[done])
                done += 1

        # The automaton tells ends in order, and for one end the longest piece, of the earliest start, first.
        for last, (length, own) in self.automaton.iter(text) if self.scores else ():
            if last != end:
                settle(last)
                end, best, single = last, float("-inf"), False
            start = last + 1 - length
            new = score[start] + own
            if new > best:
                best, pieces = new, count[start] + 1
            if length == 1:
                single = True
        settle(n)
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.count_run(text)
        # The usual case of single spaces needs no pattern.
        words = [MARK + w for w in text[1:].split(MARK)] if MARK * 2 not in text and text[-1] != MARK else RUN.findall(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        total = 0
        for w in words:
            if w not in self.known:
                if len(w) <= LONGEST:
                    self.known[w] = self.count_run(w)
                else:  # a text without spaces can be a word of megabytes, which isn't kept
                    total += self.count_run(w)
        return total + sum(map(self.known.get, words, repeat(0)))


@lru_cache(2)
def load_vocabulary(path: str) -> Vocabulary:
    """Normal and user-defined pieces of a sentencepiece model file, read as a unigram vocabulary."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return Vocabulary([(p.piece, float(p.score)) for p in model.pieces if p.type in (1, 4)])


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per document: doc_id, n_chars (code points), n_tokens."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        vocabulary = load_vocabulary(vocabulary_path)
        return pd.Series([vocabulary.count(t or "") for t in texts], dtype="int64")

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), count(text).alias("n_tokens"))
