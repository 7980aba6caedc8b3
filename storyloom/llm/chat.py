"""Chat formatting: every assistant turn is an example of its own, with all turns before it as context.

Format. An example is a context (everything said before, formatted) and a target (the reply, formatted); only the reply's
own text carries loss. Contexts of one conversation are prefixes of one another, so they are stored once: the rows of a
conversation are its parts in order, each with what it adds to the context (`context_delta`) and, where an assistant turn
comes next, that example's `target`. A part holds at most PART_CHARS of context, or one turn where that is longer, so a
conversation without replies is many rows and not one. An example's text is, exactly, the deltas and targets of all parts
before its own, its own delta, and its target; `expand` writes that out for whoever wants examples in full, which grows
with the square of a conversation. Turns after the last assistant turn are parts without a target, so nothing is lost.

Template: a turn is `<|role|>text</s>` plus a line break, where role and text are escaped: a backslash goes before each
backslash, `<`, `[` and `|`, so no control string can come from inside a text, and removing the backslashes gives the
text back.

A conversation is read in order of turn within a sorted partition, one turn at a time; digests are taken as the rows go
by. A conversation that holds a third of all rows takes one task's time, since its digest hangs on its order, but no more
memory than a part and its longest turn.

Defined results: a null text is empty; a null role is the empty role; a null turn comes first; equal turns are ordered
by role, then text; repeated rows are turns like any other; rows with a null conv_id form one conversation; an empty
table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_map, spill_table, table

_CONTROL = re.compile(r"[\\<\[|]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|((?:[^\\|]|\\.)*)\|>((?:[^\\<]|\\.)*)</s>\n", re.S)
TRAINED = "assistant"
PART_CHARS = 1 << 16  # of context in a part


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"<|{escape(role)}|>{escape(text)}</s>\n"


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn; the inverse of joined `format_turn`s."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


def reply_span(target: str) -> tuple[int, int]:
    """Where the loss lies in a formatted reply: its escaped text, without the markers."""
    m = _TURN.fullmatch(target)
    return m.span(2)


def _ordered(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def examples(conversations: DataFrame, trained: str = TRAINED, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, example, context_turns, context_chars, context_delta, target, loss_start, loss_end): see above.

    `example` counts replies and is null in parts without one; context_turns and context_chars count the whole context,
    up to the end of the part's delta; loss_start and loss_end are the trainable code points of `target`."""
    names = ("conv_id", "part", "example", "context_turns", "context_chars", "context_delta", "target", "loss_start", "loss_end")

    def run(blocks):
        conv, part, replies, turns, chars, delta, held = object(), 0, 0, 0, 0, [], 0

        def row(target=None):
            nonlocal part, replies, turns, chars, delta, held
            start, end = reply_span(target) if target else (None, None)
            out = (conv, part, replies if target else None, turns, chars + held, "".join(delta), target, start, end)
            part, chars, delta, held = part + 1, chars + held + len(target or ""), [], 0
            replies, turns = replies + bool(target), turns + bool(target)
            return out

        for ids, _, roles, texts in blocks:
            rows = []
            for i, role, text in zip(ids, roles, texts):
                if i != conv:
                    if delta:
                        rows.append(row())
                    conv, part, replies, turns, chars = i, 0, 0, 0, 0
                turn = format_turn(role, text)
                if role == trained:
                    rows.append(row(turn))
                    continue
                if delta and held + len(turn) > part_chars:
                    rows.append(row())
                delta.append(turn)
                held, turns = held + len(turn), turns + 1
            yield dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}
        if delta:
            yield dict(zip(names, zip(row())))

    schema = "conv_id long, part long, example long, context_turns long, context_chars long, context_delta string, target string, loss_start long, loss_end long"
    return arrow_map(_ordered(conversations), run, schema)


def expand(formatted: DataFrame) -> DataFrame:
    """Each example's whole text: (conv_id, example, text, loss_start, loss_end). Grows with the square of a
    conversation's turns; for training jobs on conversations of ordinary length."""
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = F.collect_list(F.concat("context_delta", F.coalesce("target", F.lit("")))).over(before)
    whole = formatted.withColumn("text", F.array_join(parts, "")).where("target is not null")
    return whole.select("conv_id", "example", "text", (F.col("context_chars") + F.col("loss_start")).alias("loss_start"), (F.col("context_chars") + F.col("loss_end")).alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: turns, their digest, and everything under the loss mask."""

    def run(blocks: Iterable[list]):
        conv, state = object(), None
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_chars")

        def done():
            n, turns, loss_n, loss, chars, wide = state
            return conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars, wide

        for ids, _, before, deltas, targets, starts, ends in blocks:
            rows = []
            for i, ahead, delta, target, s, e in zip(ids, before, deltas, targets, starts, ends):
                if i != conv:
                    if state:
                        rows.append(done())
                    conv, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for part in (delta, target or ""):
                    for role, text in parse_turns(part):
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                    state[4] += len(part)
                if target:
                    reply = unescape(target[s:e])
                    state[2] += len(reply)
                    state[3].update(reply.encode())
                    state[5] += ahead + len(target)
            yield dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}
        if state:
            yield dict(zip(names, zip(done())))

    columns = ["conv_id", "part", "context_chars", "context_delta", "target", "loss_start", "loss_end"]
    ordered = formatted.select(columns).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return arrow_map(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_chars long")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return read_back(spill_table(examples(rows.unionByName(extra))))
