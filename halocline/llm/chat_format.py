"""Chat formatting by event-sourced reconstruction.

The log holds events (conv_id, seq, turn, kind, role, text); seq orders all events of a conversation, across its turns.
Logs are partitioned by conversation and sorted by sequence, which gives every event its place; the events are then
folded in that order: `message` opens a turn or replaces it with a role and a text, `delta` appends streamed text, `edit`
replaces the text, `regenerate` drops it for a new attempt. Since an event touches one turn only, each turn's events are
folded one after another in order of place, wherever other turns' events stood between them, and one turn at a time is
in memory. Final messages come in order of turn and are rendered to one text a conversation, in rows of bounded length.

Partitioning is asked for by a window, so that a log which is partitioned by conversation already isn't moved again.
A conversation streams through one task in bounded memory, however long: its text is one sequence, and so is its digest.

Template: `<s>` opens a conversation; a user's text stands between [INST] and [/INST], a system's between [SYS] and
[/SYS], any other role's between [TURN] and [/TURN] with its name before [SEP]; an assistant's text is closed by `</s>`.
Texts under the loss mask are the assistant's alone. Control strings inside texts and names get a backslash behind
their first character, one more if they have some already, which parsing takes off again.

Defined results: null text and null role are empty; a null seq or turn sorts first; events equal in seq are taken in
order of kind, role and text; events repeated whole are repeated; a turn without `message` has the role of its first
event; texts of any length are taken whole; a conversation without events has no rows; an empty log gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, small_batches

START, STOP = "<s>", "</s>"
ROLES = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]")}
OTHER, SEP = ("[TURN]", "[/TURN]"), "[SEP]"
#: Control strings by their first character and the rest.
PLAIN = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?TURN\]|SEP\])")
PART = 1 << 16  # characters a row of formatted text
MESSAGES = "conv_id bigint, turn bigint, role string, text string"
FORMATTED = "conv_id bigint, part bigint, formatted string"
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, formatted_sha256 string"


def escaped(text: str) -> str:
    return PLAIN.sub(r"\1\2\\\3", text)


def unescaped(text: str) -> str:
    return PLAIN.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def rendered(role: str, text: str) -> str:
    if role == "assistant":
        return escaped(text) + STOP
    if role in ROLES:
        return ROLES[role][0] + escaped(text) + ROLES[role][1]
    return OTHER[0] + escaped(role) + SEP + escaped(text) + OTHER[1]


class _Reader:
    """Text that comes in chunks, of which only what isn't read yet is held."""

    def __init__(self, chunks: Iterable[str]):
        self.chunks, self.held = iter(chunks), ""

    def more(self) -> bool:
        chunk = next((c for c in self.chunks if c), None)
        self.held += chunk or ""
        return chunk is not None

    def takes(self, mark: str) -> bool:
        """Whether `mark` comes next; if so, it is read."""
        while len(self.held) < len(mark) and mark.startswith(self.held) and self.more():
            pass
        found = self.held.startswith(mark)
        if found:
            self.held = self.held[len(mark) :]
        return found

    def until(self, mark: str) -> str:
        """What stands before `mark`; both are read."""
        parts = []
        while (at := self.held.find(mark)) < 0:
            cut = max(0, len(self.held) - len(mark) + 1)
            parts.append(self.held[:cut])
            self.held = self.held[cut:]
            if not self.more():
                raise ValueError(f"{mark} is missing")
        parts.append(self.held[:at])
        self.held = self.held[at + len(mark) :]
        return "".join(parts)


def parsed(chunks: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Turns (role, text) of a conversation's formatted text, in chunks cut anywhere."""
    reader = _Reader(chunks)
    if not reader.takes(START):
        raise ValueError(f"{START} is missing")
    while reader.held or reader.more():
        for role, (first, last) in (*ROLES.items(), ("", OTHER)):
            if reader.takes(first):
                body = reader.until(last)
                if not role:
                    role, body = body.split(SEP, 1)
                    role = unescaped(role)
                yield role, unescaped(body)
                break
        else:
            yield "assistant", unescaped(reader.until(STOP))


def _batches(rows, schema: str, size: int = 512, chars: int = 1 << 20):
    """Record batches of tuples, of `size` rows at most and about `chars` characters in the last text column."""
    kinds = [(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in schema.split(", ")]
    held, n = [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])
    for row in rows:
        held.append(row)
        n += len(row[-1] or "")
        if len(held) == size or n >= chars:
            yield made()
            held, n = [], 0
    if held:
        yield made()


def fold(rows):
    """Final messages of sorted events (conv_id, turn, kind, role, text); holds one turn at a time."""
    key, role, parts = None, None, []
    for conv, turn, kind, who, text in rows:
        if key != (conv, turn) and key is not None:
            yield (*key, role or "", "".join(parts))
        if key != (conv, turn):
            key, role, parts = (conv, turn), None, []
        if kind == "message":
            role, parts = who, [text or ""]
        elif kind == "edit":
            parts = [text or ""]
        elif kind == "regenerate":
            parts = []
        elif kind == "delta":
            parts.append(text or "")
        role = who if role is None else role
    if key is not None:
        yield (*key, role or "", "".join(parts))


def sequenced(events: DataFrame) -> DataFrame:
    """(conv_id, turn, kind, role, text, place) in the order in which they are folded; place is the event's in its conversation."""
    log = events.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("seq").cast("bigint"), "kind", "role", "text")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "kind", "role", "text"))
    return log.withColumn("place", place).drop("seq").sortWithinPartitions("conv_id", "turn", "place")


def final_messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the folded messages."""

    def run(batches):
        yield from _batches(fold(r[:5] for r in rows_of(batches, 256)), MESSAGES)

    small_batches(events.sparkSession)
    return sequenced(events).mapInArrow(run, MESSAGES)


def formatted(events: DataFrame, size: int = PART) -> DataFrame:
    """conv_id, part, formatted: each conversation rendered as one text, cut into rows of `size` characters at most.

    The rows of a conversation follow each other in one partition."""

    def parts(messages):
        for conv, turns in groupby(messages, lambda m: m[0]):
            part, held = 0, START
            for _, _, role, text in turns:
                held += rendered(role, text)
                whole = len(held) - len(held) % size
                for at in range(0, whole, size):
                    yield conv, part, held[at : at + size]
                    part += 1
                held = held[whole:]
            if held:
                yield conv, part, held

    def run(batches):
        yield from _batches(parts(fold(r[:5] for r in rows_of(batches, 256))), FORMATTED)

    small_batches(events.sparkSession)
    return sequenced(events).mapInArrow(run, FORMATTED)


def conversation_digests(texts: DataFrame, in_order: bool = False) -> DataFrame:
    """Per conversation, from its whole formatted text (conv_id, part, formatted) read back: turns, digests and the text
    under the loss mask. Rows stream past; only running digests and one turn are kept.

    `in_order` tells that rows come as formatted() gives them; else they are dealt by conversation and sorted first.
    """

    def read(rows):
        for conv, parts in groupby(rows, lambda r: r[0]):
            n, chars, size = 0, 0, 0
            turns, loss, whole = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()

            def chunks(parts=parts, whole=whole):
                nonlocal size
                for _, text in parts:
                    size += len(text)
                    whole.update(text.encode("utf-8", "surrogatepass"))
                    yield text

            for role, text in parsed(chunks()):
                n += 1
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role == "assistant":
                    chars += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
            yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, whole.hexdigest()

    def run(batches):
        yield from _batches(read(rows_of(batches, 64)), DIGESTS)

    if not in_order:
        texts = texts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return texts.select("conv_id", "formatted").mapInArrow(run, DIGESTS)


def events_of_turns(conversations: DataFrame, chunk: int = 256) -> DataFrame:
    """The event log behind finished turns (conv_id, turn, role, text).

    User and other turns are one message; long ones were cut off, and are edited when the conversation is over, after
    all other events. Assistant turns are streamed in chunks, after a first attempt that was thrown away. Turns are
    numbered anew from 0; those with equal numbers follow each other in order of role and text; a null number sorts
    first; repeated rows are repeated turns.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("at"), role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("at", "role", "text")
    chunks = F.greatest(F.lit(1), F.ceil(F.char_length("text") / chunk)).cast("bigint")
    taken = F.when(F.col("role") == "assistant", chunks + 3).otherwise(1)
    before = F.coalesce(F.sum(taken).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = rows.withColumns({"turn": F.row_number().over(order).cast("bigint") - 1, "first": before})
    one = lambda seq, kind, text: F.struct(seq.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    first = F.col("first")
    streamed = F.concat(
        F.array(one(first, "message", F.lit("")), one(first + 1, "delta", F.substring("text", 1, 40)), one(first + 2, "regenerate", F.lit(""))),
        F.transform(F.sequence(F.lit(0).cast("bigint"), chunks - 1), lambda i: one(first + 3 + i, "delta", F.substring(F.col("text"), (i * chunk + 1).cast("int"), F.lit(chunk)))),
    )
    late = F.lit(1 << 62) + F.col("turn")
    typed = F.when(chunks > 1, F.array(one(first, "message", F.substring("text", 1, chunk)), one(late, "edit", F.col("text")))).otherwise(F.array(one(first, "message", F.col("text"))))
    event = F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("e")
    return each.select("conv_id", "turn", "role", event).select("conv_id", "e.seq", "turn", "e.kind", "role", "e.text")
