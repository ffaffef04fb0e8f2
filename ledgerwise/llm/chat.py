"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives every role the control strings before and after its text, and says whether the
text counts for the loss. Control strings inside texts are escaped reversibly. Formatting yields
one row per segment with its own loss flag; reading back parses the joined segments again.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """How a role's turns look, and whether their text is learned."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles, the form of any other role, and which role may follow which."""

    roles: dict[str, Part]
    other: tuple[str, str, str]
    # State machine: from a state, by a role, to a state. Where there is no way, order is broken.
    moves: dict[tuple[str, str], str] = field(default_factory=dict)
    start: str = "start"

    @cached_property
    def controls(self) -> tuple[str, ...]:
        """All control strings, longer ones first."""
        own = {s.strip() for p in self.roles.values() for s in (p.before, p.after)}
        return tuple(sorted(own | {s.strip() for s in self.other}, key=lambda s: (-len(s), s)))

    @cached_property
    def _control(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, self.controls)))

    @cached_property
    def _turn(self) -> re.Pattern:
        forms = [
            f"{re.escape(p.before)}(?P<r{k}>.*?){re.escape(p.after)}"
            for k, p in enumerate(self.roles.values())
        ]
        name, middle, after = map(re.escape, self.other)
        forms.append(f"{name}(?P<name>.*?){middle}(?P<text>.*?){after}")
        return re.compile("|".join(forms), re.DOTALL)

    def escape(self, text: str) -> str:
        """Double backslashes, and put one after the first character of every control string."""
        doubled = text.replace("\\", "\\\\")
        return self._control.sub(lambda m: m[0][0] + "\\" + m[0][1:], doubled)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of a turn: control strings and the escaped text, each with its loss flag."""
        part = self.roles.get(role)
        if part:
            return [(part.before, False), (self.escape(text), part.loss), (part.after, False)]
        name, middle, after = self.other
        return [(name + self.escape(role) + middle, False), (self.escape(text), False), (after, False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of formatted turns; fails on anything else."""
        names, turns, at = list(self.roles), [], 0
        while at < len(formatted):
            found = self._turn.match(formatted, at)
            if not found:
                raise ValueError(f"no turn at character {at}")
            if found["name"] is not None:
                turns.append((self.unescape(found["name"]), self.unescape(found["text"])))
            else:
                k = next(k for k in range(len(names)) if found[f"r{k}"] is not None)
                turns.append((names[k], self.unescape(found[f"r{k}"])))
            at = found.end()
        return turns


TEMPLATE = Template(
    roles={
        "system": Part("<<SYS>> ", " <</SYS>>"),
        "user": Part("[INST] ", " [/INST]"),
        "assistant": Part("<s> ", " </s>", loss=True),
    },
    other=("<<ROLE>> ", " <<TEXT>> ", " <</ROLE>>"),
    moves={
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
)
_SEGMENTS = pa.schema(
    [
        ("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment_no", pa.int32()),
        ("segment", pa.string()), ("loss", pa.bool_()), ("in_order", pa.bool_()),
    ]
)


def _format(template: Template):
    def run(batches):
        conv, state, number, fresh = None, template.start, 0, True
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if fresh or row["conv_id"] != conv:
                    conv, state, number, fresh = row["conv_id"], template.start, 0, False
                number += 1
                state = template.moves.get((state, row["role"]), "broken")
                for k, (segment, loss) in enumerate(template.segments(row["role"], row["text"])):
                    rows.append(
                        {
                            "conv_id": conv, "turn_no": number, "segment_no": k, "segment": segment,
                            "loss": loss, "in_order": state != "broken",
                        }
                    )
            yield pa.RecordBatch.from_pylist(rows, _SEGMENTS)

    return run


def format_chats(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Segments of all conversations: conv_id, turn_no, segment_no, segment, loss, in_order.

    Turns are taken by (turn, role, text), nulls first; rows that repeat are turns of their own. A
    null role or text is empty, a null conv_id a conversation of its own. `in_order` is false from
    the first turn on that the state machine doesn't allow. All segments of a conversation are in
    one partition, in order, and are made while reading, so a long conversation needs no memory.
    Other columns are not read; no rows give no rows.
    """
    source = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    ordered = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(
        _format(template),
        "conv_id long, turn_no long, segment_no int, segment string, loss boolean, in_order boolean",
    )


_DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
        ("in_order", pa.bool_()),
    ]
)


def _digest(template: Template):
    def run(batches):
        conv, open_row, ordered = None, None, True
        pending: list[str] = []

        def close_turn():
            for role, text in template.parse("".join(pending)):
                open_row["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                open_row["n"] += 1
            pending.clear()

        def finish():
            close_turn()
            return {
                "conv_id": conv, "n_turns": open_row["n"], "turns_sha256": open_row["turns"].hexdigest(),
                "loss_chars": open_row["chars"], "loss_sha256": open_row["loss"].hexdigest(),
                "formatted_chars": open_row["formatted"], "in_order": ordered,
            }

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if open_row is None or row["conv_id"] != conv:
                    if open_row is not None:
                        done.append(finish())
                    conv, ordered = row["conv_id"], True
                    open_row = {
                        "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0,
                        "formatted": 0,
                    }
                if row["segment_no"] == 0:
                    close_turn()
                pending.append(row["segment"])
                open_row["formatted"] += len(row["segment"])
                ordered = row["in_order"]
                if row["loss"]:
                    text = template.unescape(row["segment"])
                    open_row["chars"] += len(text)
                    open_row["loss"].update(text.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_pylist(done, _DIGESTS)
        if open_row is not None:
            yield pa.RecordBatch.from_pylist([finish()], _DIGESTS)

    return run


def read_back(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Per conversation, from its segments as `format_chats` leaves them: counts and digests.

    Turns come from parsing the joined segments, the loss text from the flags. `in_order` is the
    state machine's verdict on the whole conversation.
    """
    return segments.mapInArrow(
        _digest(template),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, in_order boolean",
    )
