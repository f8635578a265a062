"""Chat formatting: a finite-state machine over roles, a declarative template, and segments with loss flags.

Rows of a conversation are brought together and sorted, then streamed: no task holds more than a turn and the state, so
a conversation of any length (its hash needs all its turns in order) only makes a longer task, not a larger one. Spark
spills the sort.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (state, role) -> state. What isn't listed leads to "broken", which stays.
TURN_ORDER = {
    ("start", "system"): "primed",
    ("start", "user"): "asked",
    ("primed", "user"): "asked",
    ("asked", "assistant"): "answered",
    ("answered", "user"): "asked",
}


@dataclass(frozen=True)
class Template:
    """names: what known roles are called in the opening mark; any other role is written out after `=`, its colons escaped.

    Inside texts the escape sign, `start` and `close` get an escape sign in front, so the first unescaped `close` ends a turn.
    """

    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    start: str = "###"
    close: str = "</turn>"
    after: str = "\n"
    learned: frozenset[str] = frozenset({"assistant"})

    def escape(self, text: str) -> str:
        return text.replace("\\", "\\\\").replace(self.start, "\\" + self.start).replace(self.close, "\\" + self.close)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss flag) of a turn."""
        name = self.names.get(role) or "=" + self.escape(role).replace(":", "\\:")
        return [(f"{self.start} {name}: ", False), (self.escape(text), role in self.learned), (self.close + self.after, False)]

    def turn(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        at = len(self.start) + 1
        m = re.compile(r"(?:\\.|[^\\:])*", re.S).match(formatted, at)
        name, body = m[0], formatted[m.end() + 2 : len(formatted) - len(self.close + self.after)]
        if not formatted.startswith(self.start + " ") or formatted[m.end() : m.end() + 2] != ": ":
            raise ValueError("no opening mark")
        roles = {v: k for k, v in self.names.items()}
        return (self.unescape(name[1:]) if name[:1] == "=" else roles[name]), self.unescape(body)

    def end(self, formatted: str, start: int = 0) -> int:
        """Where the first turn ends; -1 if it doesn't yet."""
        mark = self.close + self.after
        while (at := formatted.find(mark, start)) >= 0:
            back = at
            while back and formatted[back - 1] == "\\":
                back -= 1
            if (at - back) % 2 == 0:
                return at + len(mark)
            start = at + 1
        return -1


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """A conversation's rows in one partition, in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


SEGMENTS = "turn long, part int, text string, loss boolean, state string"


def format_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments (conv_id, turn, part, text, loss, state) of conversations (conv_id, turn, role, text), in order.

    state: the machine's after this turn; "broken" from the first turn that is out of order on. Null text: empty. Null
    role: the empty role. Null turn: before the others. Turns of the same number go by role, then text; null conv_id is a
    conversation too. Repeated rows are turns of their own. Other columns are not looked at; no rows, no segments.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = (), ""
        for batch in batches:
            conv, turn, part, text, loss, states = [], [], [], [], [], []
            for c, t, role, own in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text"))):
                if current != (c,):
                    current, state = (c,), "start"
                state = TURN_ORDER.get((state, role), "broken")
                for i, (s, learned) in enumerate(template.segments(role, own)):
                    conv.append(c), turn.append(t), part.append(i), text.append(s), loss.append(learned), states.append(state)
            yield pa.record_batch([pa.array(conv, batch.schema.field("conv_id").type), pa.array(turn, pa.int64()), pa.array(part, pa.int32()), pa.array(text, pa.string()), pa.array(loss, pa.bool_()), pa.array(states, pa.string())], names=["conv_id", "turn", "part", "text", "loss", "state"])

    return in_order(rows, "turn", "role", "text").mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {SEGMENTS}")


class _Reader:
    """Reads one conversation's output segment by segment."""

    def __init__(self, conv: object, template: Template):
        self.conv, self.template = conv, template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.rest, self.state = "", "start"

    def add(self, text: str, loss: bool, state: str) -> None:
        self.chars += len(text)
        self.state = state
        if loss:
            own = self.template.unescape(text)
            self.loss_chars += len(own)
            self.loss.update(own.encode())
        start = max(0, len(self.rest) - len(self.template.close + self.template.after))
        self.rest += text
        while (end := self.template.end(self.rest, start)) >= 0:
            role, own = self.template.turn(self.rest[:end])
            self.turns.update(f"{role}\n{own}\n".encode())
            self.n += 1
            self.rest, start = self.rest[end:], 0

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("the output ends inside a turn")
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.state == "answered"


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """A row a conversation, from what format_turns() gave: the turns are parsed out of the formatted text again.

    segments must be in order as format_turns() leaves them; stored ones go through in_order(segments, "turn", ...) first.
    valid: whether the machine ended after an answer, having met no turn out of order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        kind = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows)
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

        for batch in batches:
            kind, rows = batch.schema.field("conv_id").type, []
            for c, text, loss, state in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "text", "loss", "state"))):
                if reader is None or reader.conv != c:
                    if reader is not None:
                        rows.append(reader.row())
                    reader = _Reader(c, template)
                reader.add(text, loss, state)
            if rows:
                yield out(rows)
        if reader is not None:
            yield out([reader.row()])

    kind = segments.schema["conv_id"].dataType.simpleString()
    return segments.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
