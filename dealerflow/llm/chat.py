"""Conversations as training text: a declarative template, a state machine over roles, loss flags.

Rows are dealt by conversation and sorted by turn, then streamed: a task holds
one turn and the machine's state, never a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Turn:
    """How a role's turns look and whether their texts are learned."""

    open: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks, loss flags and the machine: which role may follow which, and which may end.

    A role without an entry is written as ``### [role]: `` and not learned.
    """

    turns: Mapping[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("### System: "),
            "user": Turn("### User: "),
            "assistant": Turn("### Assistant: ", loss=True),
        }
    )
    close: str = "</turn>\n"
    after: Mapping[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})

    def opening(self, role: str) -> str:
        turn = self.turns.get(role)
        return turn.open if turn else f"### [{escape(role).replace(']', _BRACKET)}]: "

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Opening, text and close, each with its loss flag."""
        turn = self.turns.get(role)
        return [(self.opening(role), False), (escape(text), bool(turn and turn.loss)), (self.close, False)]

    def allows(self, before: str, role: str) -> bool:
        return role in self.after.get(before, frozenset())


# Control strings are broken by a backslash after their first character; backslashes are doubled.
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPED = re.compile(r"\\([\\#/\]])")
_BRACKET = "\\]"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_back(formatted: str, template: Template) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted string."""
    turns, at = [], 0
    by_open = sorted(((t.open, role) for role, t in template.turns.items()), key=lambda x: -len(x[0]))
    while at < len(formatted):
        for opening, role in by_open:
            if formatted.startswith(opening, at):
                at += len(opening)
                break
        else:
            named = re.compile(r"### \[((?:\\.|[^\\\]])*)\]: ", re.DOTALL).match(formatted, at)
            if not named:
                raise ValueError(f"no turn starts at {at}")
            role, at = unescape(named[1]), named.end()
        end = formatted.index(template.close, at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(template.close)
    return turns


_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_chats(
    chats: DataFrame,
    template: Template | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn: conversation id, ``place`` (from 0), ``role``, ``segments``, ``in_order``.

    ``segments`` is an array of text and loss flag; joined it is the turn's
    training text. ``in_order`` says whether the role may follow the one before.
    A turn out of order is written all the same. The rows of a conversation stand
    together and in order: by turn (null first), ties by role and text; repeated
    rows are turns of their own. A null text is empty, a null role the empty
    role, rows with a null id are one conversation. Other columns are not read.
    """
    plan = template or Template()
    kind = chats.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, state = object(), 0, ""
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                places, roles, segments, order = [], [], [], []
                for i in range(batch.num_rows):
                    conv, role, text = (batch.column(c)[i].as_py() for c in (0, 2, 3))
                    if conv != now:
                        now, place, state = conv, 0, ""
                    role = role or ""
                    places.append(place)
                    roles.append(role)
                    segments.append([{"text": t, "loss": x} for t, x in plan.segments(role, text or "")])
                    order.append(plan.allows(state, role))
                    place, state = place + 1, role
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(places, pa.int64()), pa.array(roles, pa.string()),
                     pa.array(segments, _SEGMENTS), pa.array(order, pa.bool_())],
                    [conv_col, "place", "role", "segments", "in_order"],
                )

    rows = chats.select(conv_col, turn_col, role_col, text_col)
    rows = rows.repartition(conv_col).sortWithinPartitions(conv_col, turn_col, role_col, text_col)
    return rows.mapInArrow(
        run, f"`{conv_col}` {kind}, place bigint, role string, segments array<struct<text:string,loss:boolean>>, in_order boolean"
    )


class _Digest:
    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars, self.valid, self.last = 0, 0, 0, True, ""
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()


def digest_chats(formatted: DataFrame, template: Template | None = None, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from what ``format_chats`` returned.

    ``valid``: every turn in order, the last of a role that may end.
    """
    plan = template or Template()
    kind = formatted.schema[conv_col].dataType.simpleString()
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, d, out = None, None, []

        def close() -> None:
            ok = d.valid and d.last in plan.final
            out.append((now, d.turns, d.all.hexdigest(), d.loss_chars, d.learned.hexdigest(), d.chars, ok))

        def flush(key: pa.DataType) -> pa.RecordBatch:
            kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        key = None
        for batch in batches:
            key = batch.schema.field(0).type
            for i in range(batch.num_rows):
                conv, segments, fits = (batch.column(c)[i].as_py() for c in range(3))
                if d is None or conv != now:
                    if d is not None:
                        close()
                    now, d = conv, _Digest()
                text = "".join(s["text"] for s in segments)
                for role, said in read_back(text, plan):
                    d.all.update(f"{role}\n{said}\n".encode())
                    d.turns, d.last = d.turns + 1, role
                for s in segments:
                    if s["loss"]:
                        learned = unescape(s["text"])
                        d.learned.update(learned.encode())
                        d.loss_chars += len(learned)
                d.chars += len(text)
                d.valid = d.valid and fits
                if len(out) >= 4096:
                    yield flush(key)
        if d is not None:
            close()
        if out:
            yield flush(key)

    return formatted.select(conv_col, "segments", "in_order").mapInArrow(
        run,
        f"`{conv_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, valid boolean",
    )
