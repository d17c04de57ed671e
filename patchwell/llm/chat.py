"""Conversations as training text: a role machine, a declarative template, loss flags.

Turns go in order through a finite-state machine that says whether the order is allowed, and
come out as segments of text, each with a loss flag. Control strings inside roles and texts
are escaped, so the formatted text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class ChatTemplate:
    """``transitions[state][role]`` is the next state; roles not listed lead to ``error``, for good."""

    turn_open: str = "<|start|>"
    text_open: str = "<|message|>"
    turn_close: str = "<|end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    accepting: frozenset[str] = frozenset({"answered"})
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn_open, self.text_open, self.turn_close, *self.reserved)

    def next_state(self, state: str, role: str) -> str:
        return self.transitions.get(state, {}).get(role, "error")

    def escape(self, text: str) -> str:
        """The escape character is doubled; a control string gets one after its first character."""
        found = "|".join(map(re.escape, sorted((ESCAPE, *self.controls), key=len, reverse=True)))
        return re.sub(found, lambda m: m[0][0] + ESCAPE + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn's segments in order with their loss flags; only the text can bear loss."""
        return [
            (self.turn_open + self.escape(role) + self.text_open, False),
            (self.escape(text), role in self.loss_roles),
            (self.turn_close, False),
        ]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of a formatted conversation."""
        turns = []
        at = 0
        while at < len(formatted):
            if not formatted.startswith(self.turn_open, at):
                raise ValueError("a turn must start here")
            middle = formatted.index(self.text_open, at)
            end = formatted.index(self.turn_close, middle)
            role = formatted[at + len(self.turn_open) : middle]
            text = formatted[middle + len(self.text_open) : end]
            turns.append((self.unescape(role), self.unescape(text)))
            at = end + len(self.turn_close)
        return turns


SEGMENTS = "conv_id long, turn long, turn_index long, segment int, text string, loss boolean, state string"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)


def in_order(rows: DataFrame) -> DataFrame:
    """A conversation's turns follow each other in one partition; ties go by role and text."""
    rows = rows.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Segments of all conversations, a row each, ``state`` after the turn they belong to.

    Turns are streamed: nothing but the current batch is held, however long a conversation.
    Null roles and texts are empty strings (a null role is an order error), null turns come
    first, rows with a null ``conv_id`` form one conversation, repeated rows are turns of their
    own, an empty table gives no segments, other columns are ignored. Conversations in a wrong
    order are formatted as they are, with state ``error`` from the offending turn on."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: object = ...
        state, index = template.start, 0
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(_ids(batch.conv_id), _ids(batch.turn), batch.role, batch.text):
                if conv != current:
                    current, state, index = conv, template.start, 0
                state = template.next_state(state, role)
                for k, (piece, loss) in enumerate(template.segments(role, text)):
                    out.append((conv, turn, index, k, piece, loss, state))
                index += 1
            columns = ["conv_id", "turn", "turn_index", "segment", "text", "loss", "state"]
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64", "turn": "Int64"})

    return in_order(rows).mapInPandas(run, SEGMENTS)


def _ids(column: pd.Series) -> list[int | None]:
    return [None if pd.isna(x) else int(x) for x in column]


class _Reader:
    """Reads one conversation back from its segments, turn by turn."""

    def __init__(self, conv: int | None, template: ChatTemplate) -> None:
        self.conv, self.template = conv, template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.open: list[str] = []
        self.state = template.start

    def add(self, text: str, loss: bool, state: str) -> None:
        self.open.append(text)
        self.chars += len(text)
        self.state = state
        if loss:
            plain = self.template.unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        if text == self.template.turn_close:
            for role, plain in self.template.parse("".join(self.open)):
                self.n_turns += 1
                self.turns.update(f"{role}\n{plain}\n".encode())
            self.open = []

    def row(self) -> tuple:
        valid = self.state in self.template.accepting
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid


def read_back(segments: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests of what the formatted conversations say; segments must come as
    :func:`format_turns` leaves them, whose order this keeps. One running digest a conversation."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader: _Reader | None = None
        done: list[tuple] = []
        for batch in batches:
            for conv, text, loss, state in zip(_ids(batch.conv_id), batch.text, batch.loss, batch.state):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv, template)
                reader.add(text, loss, state)
            if len(done) >= 1000:
                yield _digests(done)
                done = []
        if reader is not None:
            done.append(reader.row())
        if done:
            yield _digests(done)

    return segments.mapInPandas(run, DIGESTS)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    names = [x.strip().split(" ")[0] for x in DIGESTS.split(",")]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
