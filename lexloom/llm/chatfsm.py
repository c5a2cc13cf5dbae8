"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Each turn becomes segments of text with a loss flag, and the formatted text is their concatenation. Control
strings inside texts are escaped reversibly, so the output can be read back. What a turn becomes depends on
that turn alone; only the order of roles and the digests of a conversation need its turns one after the
other. So digests() formats and reads back before the shuffle, wherever a turn lies, and a conversation's own
task only walks the machine and hashes, with constant state however long it is; nothing gathers a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import slices


@dataclass(frozen=True)
class Turn:
    """What stands before and after a role's text, whether its text bears loss, and which states it may follow."""

    before: str
    after: str
    loss: bool
    follows: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """Roles by name. Roles that are not listed are invalid turns; they are marked by name between opener and closer."""

    turns: dict[str, Turn]
    opener: str = "[TURN="
    closer: str = "[/TURN]"
    escape: str = "\\"
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    extra_controls: tuple[str, ...] = field(default=())

    @cached_property
    def controls(self) -> tuple[str, ...]:
        marks = {m.strip() for t in self.turns.values() for m in (t.before, t.after)} | {self.opener, self.closer, *self.extra_controls}
        ordered = sorted(marks - {""}, key=lambda m: (-len(m), m))
        for a in ordered:
            if self.escape in a or len(a) < 2:
                raise ValueError(f"control string {a!r} can't be escaped")
            for b in ordered:
                if any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))) or (a != b and b in a):
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")
        return tuple(ordered)

    @cached_property
    def _found(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, self.controls)))

    def escaped(self, text: str) -> str:
        e = self.escape
        return self._found.sub(lambda m: m[0][0] + e + m[0][1:], text.replace(e, e + e))

    def unescaped(self, text: str) -> str:
        e = re.escape(self.escape)
        return re.sub(f"{e}({e}?)", r"\1", text)


#: The production template.
INSTRUCT = Template(
    {
        "system": Turn("<<SYS>> ", " <</SYS>>", False, ("start",)),
        "user": Turn("[INST] ", " [/INST]", False, ("start", "system", "assistant")),
        "assistant": Turn("<s> ", " </s>", True, ("user",)),
    }
)


@dataclass(frozen=True)
class Segment:
    text: str
    loss: bool


class Machine:
    """Walks the turns of one conversation; valid tells whether all so far came in an allowed order."""

    def __init__(self, template: Template) -> None:
        self.template, self.state, self.valid = template, template.start, True

    def step(self, role: str) -> Turn | None:
        known = self.template.turns.get(role)
        self.valid = self.valid and known is not None and self.state in known.follows
        self.state = role
        return known

    def turn(self, role: str, text: str) -> list[Segment]:
        known = self.step(role)
        body = self.template.escaped(text)
        if known:
            return [Segment(known.before, False), Segment(body, known.loss), Segment(known.after, False)]
        head = self.template.escaped(role).replace("]", self.template.escape + "e")
        return [Segment(f"{self.template.opener}{head}] ", False), Segment(body, False), Segment(f" {self.template.closer}", False)]

    @property
    def complete(self) -> bool:
        return self.valid and self.state in self.template.final


class Reader:
    """Reads formatted text back, piece by piece, into (role, text, loss)."""

    def __init__(self, template: Template) -> None:
        self.template, self.rest = template, ""
        opener = re.escape(template.opener)
        marks = "|".join(re.escape(t.before) for t in template.turns.values())
        self.head = re.compile(rf"(?:({marks})|{opener}((?:[^\]])*)\] )")
        self.by_mark = {t.before: (name, t) for name, t in template.turns.items()}

    def feed(self, piece: str) -> Iterator[tuple[str, str, bool]]:
        self.rest += piece
        at = 0
        while m := self.head.match(self.rest, at):
            if m[1] is not None:
                role, turn = self.by_mark[m[1]]
                after, loss = turn.after, turn.loss
            else:
                e = self.template.escape
                role = re.sub(f"{re.escape(e)}(?:({re.escape(e)})|(e)|)", lambda x: e if x[1] else "]" if x[2] else "", m[2])
                after, loss = f" {self.template.closer}", False
            end = self.rest.find(after, m.end())
            if end < 0:
                break
            yield role, self.template.unescaped(self.rest[m.end() : end]), loss
            at = end + len(after)
        self.rest = self.rest[at:]


def _plain(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _sorted(plain: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order: by turn, then role, then text."""
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _read_back(plain: DataFrame, template: Template) -> DataFrame:
    """(conv_id, turn, role, text, loss, chars): each turn as it is read back from its segments, and the characters of those."""
    names = ["conv_id", "turn", "role", "text", "loss", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, reader = Machine(template), Reader(template)
        for batch in batches:
            for part in slices(batch, 3, 4096):
                found, chars = [], []
                for _, turn, role, text in _walk([part]):
                    piece = "".join(s.text for s in machine.turn(role, text))
                    back = list(reader.feed(piece))
                    if len(back) != 1 or reader.rest:
                        raise ValueError(f"turn {turn}: the formatted text can't be read back")
                    found += back
                    chars.append(len(piece))
                cols = [pa.array([b[i] for b in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols, pa.array(chars, pa.int64())], names=names)

    return plain.mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, loss boolean, chars bigint")


def segments(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, turn, part, text, loss, valid) in order for all turns: the training text.

    valid: whether this turn and all before it came in an allowed order. Null roles and texts are empty
    ones, and the empty role is allowed nowhere. Turns that tie are ordered by role and text; repeated
    rows are turns of their own. Rows with a null conv_id form one conversation. Other columns are not
    looked at; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, now, rows, size = Machine(template), object(), [], 0
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
        flush = lambda: pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
        for conv, turn, role, text in _walk(batches):
            if conv != now:
                machine, now = Machine(template), conv
            for part, s in enumerate(machine.turn(role, text)):
                rows.append((conv, turn, part, s.text, s.loss, machine.valid))
            size += len(text)
            if len(rows) >= 3000 or size > 4_000_000:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    return _sorted(_plain(turns)).mapInArrow(run, "conv_id bigint, turn bigint, part int, text string, loss boolean, valid boolean")


def digests(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row for each conversation, read back from what segments() emits; nulls and ties as there.

    n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256 (the
    text under the loss mask, unescaped), formatted_chars, valid (turns in an allowed order that ends on a
    final role).
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return (now, n[0], all_turns.hexdigest(), n[1], lossy.hexdigest(), n[2], machine.complete)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=names)

        started, now, rows = False, None, []
        for conv, _, role, text, loss, chars in _walk(batches):
            if not started or conv != now:
                if started:
                    rows.append(row())
                    if len(rows) >= 5000:
                        yield flush()
                        rows = []
                started, now = True, conv
                machine, all_turns, lossy, n = Machine(template), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            machine.step(role)
            data = text.encode("utf-8", "surrogatepass")
            all_turns.update(role.encode("utf-8", "surrogatepass") + b"\n" + data + b"\n")
            if loss:
                n[1] += len(text)
                lossy.update(data)
            n[0] += 1
            n[2] += chars
        if started:
            rows.append(row())
            yield flush()

    return _sorted(_read_back(_plain(turns), template)).mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"
    )
