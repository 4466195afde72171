"""Packing by power-of-two decomposition.

Every document's token ids, closed by an end id, are cut into pieces whose lengths are powers of two: as many of the
longest length as fit, then the binary digits of what is left, longest first. Each piece is a sequence of its own in
the bucket of its length, so no sequence crosses documents and none needs padding.

Tokenizing goes word by word with a memory of bounded size, which forgets the words not seen lately and never keeps long
ones: the tokenizer splits at white space anyway, so a text's ids are those of its words in turn. Texts with characters that Python and the tokenizer class differently as white space go whole. The
tokenizer lower-cases; where a text's characters are such that Python does so alike, that comes before the lookup.

Defined results: null or empty text gives the end id alone; repeated rows and equal texts are packed each; a null
doc_id is passed on; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, small_batches

MAX_LENGTH, END_ID = 4096, 2
#: Words that a worker gathers before it forgets those not seen for as long, and the characters of the longest it keeps.
REMEMBERED, LONGEST = 200_000, 64
ROWS, HELD = 32, 20_000  # texts taken from a batch at once; pieces (or ids, if they are returned) gathered before they are handed on
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^`{}~"  # ASCII signs that start no special token or contraction
ODD_SPACE = "\x1c\x1d\x1e\x1f"


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two, falling, that add up to n; only the longest may repeat."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def latin(text: str) -> bool:
    """Whether all characters are below U+0100, where lower-casing is one character for one."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Words:
    """Ids of words, kept as bytes of unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that close a word
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # what was known before the words gathered now

    def whole(self, text: str) -> bytes:
        return self.encoded(text).tobytes()

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")  # fast: no offsets

    def learn(self, words: set[str]) -> None:
        """Words of letters alone are one run to the tokenizer, so many are encoded as one text and parted at the ids
        that close a word; ASCII signs behind letters are a run of their own."""
        known, stems, parts = self.known, set(), []
        for w in words:
            stem = w.rstrip(SIGNS)
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250" and "\u0130" not in stem):
                tail = w[len(stem) :]
                stem = stem.lower()
                if w != stem:
                    parts.append((w, stem, tail))
                if stem not in known:
                    stems.add(stem)
            else:
                known[w] = self.whole(w)
        if stems:
            order = list(stems)
            ids = self.encoded(" ".join(order))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(order):
                raw, start = ids.tobytes(), 0
                for w, end in zip(order, (4 * cuts).tolist(), strict=True):
                    known[w] = raw[start:end]
                    start = end
            else:  # a vocabulary that parts words otherwise
                for w in order:
                    known[w] = self.whole(w)
        for w, stem, tail in parts:
            if tail and tail not in known:
                known[tail] = self.whole(tail)
            known[w] = known[stem] + (known[tail] if tail else b"")

    def ids(self, text: str) -> bytes:
        if any(c in text for c in ODD_SPACE):
            return self.whole(text)
        if latin(text) and "<|" not in text:  # special tokens are told by their case
            text = text.lower()
        words = text.split()
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        found = list(map(self.known.get, words))
        if None in found:
            missing = {w for w, ids in zip(words, found, strict=True) if ids is None}
            again = missing & self.before.keys()
            for w in again:
                self.known[w] = self.before[w]
            long = {w: self.whole(w) for w in missing if len(w) > LONGEST}  # a text without spaces can be a word of megabytes
            self.learn(missing - again - long.keys())
            found = [long[w] if w in long else self.known[w] for w in words] if long else list(map(self.known.__getitem__, words))
        return b"".join(found)


@lru_cache(1)
def _words(path: str) -> _Words:
    return _Words(path)


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of `text` as the tokenizer file at `path` gives them without special tokens added."""
    return np.frombuffer(_words(path).ids(text), "<u4")


def pack(docs: DataFrame, tokenizer_path: str, longest: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the ids."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def batch_of(cols: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def cut(batches):
        cols, held = [[] for _ in names], 0
        for doc_id, text in rows_of(batches, ROWS):
            ids = np.append(token_ids(text or "", tokenizer_path), np.array([end_id], "<u4")).astype("<u4")
            start, raw = 0, memoryview(ids.tobytes())
            for length in piece_lengths(len(ids), longest):
                piece = (doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(ids))
                for c, v in zip(cols, (*piece, ids[start : start + length].astype(np.int32)) if with_ids else piece, strict=True):
                    c.append(v)
                start += length
                held += length if with_ids else 1
                if held >= HELD:
                    yield batch_of(cols)
                    cols, held = [[] for _ in names], 0
        if held:
            yield batch_of(cols)

    small_batches(docs.sparkSession)
    pieces = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))
    # One sequence per piece. The number tells its bucket too: sequences of one length have the same remainder.
    bits = longest.bit_length()
    number = F.monotonically_increasing_id() * bits + F.log2(F.col("length").cast("double")).cast("long")
    return pieces.withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")})
