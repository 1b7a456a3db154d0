"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's turns, in order, become text segments with a loss flag each.  The machine says
whether the turns come in a valid order (``TURNS``); a conversation that breaks it is formatted
all the same and marked.  The template gives each role its opening, closing and loss flag.
Control strings inside a text are escaped: a backslash is doubled, and a backslash is put after
the first character of a control string, so none is left and reading undoes it.

Turns are dealt by conversation and sorted by Spark; both formatting and reading back are
streams that hold one turn at a time, so a conversation of any length costs no memory.

Results.  Null texts are empty; a null role is the empty role.  Turns are ordered by turn, then
role, then text (nulls first), and repeated rows are turns of their own.  Rows without a conv_id
are one conversation whose id is null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import prepare, streamed

#: role: (opening, closing, loss)
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n\n", False),
    "user": ("<s>[INST] ", " [/INST]", False),
    "assistant": (" ", " </s>", True),
}
#: Any other role: its name between these two, then the text, then the closing.
OTHER = ("<|", "|>", "<|end|>")
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")
#: (state, role): next state.  Any other step breaks the conversation.
TURNS = {("start", "system"): "ready", ("start", "user"): "asked", ("ready", "user"): "asked",
         ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
FINAL = ("answered",)

_FIND = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))


def escape(text: str) -> str:
    return _FIND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str, template: dict = TEMPLATE) -> list[tuple[str, bool]]:
    """Segments of one turn; empty ones are left out."""
    if role in template:
        opening, closing, loss = template[role]
    else:
        opening, closing, loss = OTHER[0] + escape(role) + OTHER[1], OTHER[2], False
    return [(t, f) for t, f in ((opening, False), (escape(text), loss), (closing, False)) if t]


def read_turn(text: str, at: int, template: dict = TEMPLATE) -> tuple[str, int, int, int] | None:
    """(role, start and end of the escaped text, end of the turn) of the turn at ``at``, or None if it isn't whole."""
    for role, (opening, closing, _) in template.items():
        if text.startswith(opening, at):
            start = at + len(opening)
            break
    else:
        if not text.startswith(OTHER[0], at) or (end := text.find(OTHER[1], at + len(OTHER[0]))) < 0:
            return None
        role, start, closing = unescape(text[at + len(OTHER[0]): end]), end + len(OTHER[1]), OTHER[2]
    end = text.find(closing, start)
    return None if end < 0 else (role, start, end, end + len(closing))


@streamed
def _format(batches: Iterator[pa.RecordBatch], template: dict) -> Iterator[pa.RecordBatch]:
    now, state = (), "start"
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if now != (conv,):
                now, state = (conv,), "start"
            state = TURNS.get((state, role), "broken")
            for t, loss in format_turn(role or "", text or "", template):
                for col, x in zip(out, (conv, t, loss, state)):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.string())],
                                         ["conv_id", "text", "loss", "state"])


def format_chats(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """(conv_id, text, loss, state) of every segment; a conversation's segments are in order in one partition."""
    prepare(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(partial(_format, template=template), "conv_id long, text string, loss boolean, state string")


class _Reader:
    """Reads one conversation's segments back, turn by turn."""

    def __init__(self, conv: int | None, template: dict):
        self.conv, self.template, self.buffer, self.spans = conv, template, "", []
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.state = "start"

    def add(self, text: str, loss: bool, state: str) -> None:
        if loss:
            self.spans.append((len(self.buffer), len(self.buffer) + len(text)))
        self.buffer += text
        self.chars += len(text)
        self.state = state
        if loss or not (found := read_turn(self.buffer, 0, self.template)):
            return
        role, start, end, stop = found
        if stop != len(self.buffer):
            return
        self.turns.update(f"{role}\n{unescape(self.buffer[start:end])}\n".encode("utf-8", "surrogatepass"))
        for a, b in self.spans:
            t = unescape(self.buffer[a:b])
            self.loss_chars += len(t)
            self.loss.update(t.encode("utf-8", "surrogatepass"))
        self.buffer, self.spans, self.n = "", [], self.n + 1

    def row(self) -> tuple:
        return (self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.state in FINAL and not self.buffer)


@streamed
def _read(batches: Iterator[pa.RecordBatch], template: dict) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    reader = None
    for batch in batches:
        done = []
        for conv, text, loss, state in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if reader is None or reader.conv != conv:
                if reader is not None:
                    done.append(reader.row())
                reader = _Reader(conv, template)
            reader.add(text, loss, state)
        if done:
            yield batch_of(done)
    if reader is not None:
        yield batch_of([reader.row()])


def read_chats(segments: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """A row per conversation of ``format_chats``' output, from the formatted text alone."""
    return segments.mapInArrow(partial(_read, template=template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
