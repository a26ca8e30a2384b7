r"""Chat formatting by a finite-state machine over roles and a declarative template.

A template says how each role's turn is opened and closed, whether its text carries loss, and which
role may follow which. ``format_turns`` emits text segments with loss flags, three for each turn
(opening mark, escaped text, closing mark); the segments of a conversation, in order, are its
formatted text. Control strings inside texts are escaped with a backslash, which ``Reader`` undoes.

Rows of a conversation come to one task in order of turn and stream through it: memory is bounded by
one turn, however long the conversation.

Defined results: a null text counts as empty, a null role as the empty role; roles that the template
does not list are written in its general form and make the conversation invalid, as does a turn that
the order forbids; all are formatted nevertheless. Rows with equal turn numbers, repeated rows
included, are all kept, ordered by role, then text; null turns come first. Rows with a null
conversation id form one conversation. An empty table gives no row; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict[str, Turn]
    #: Marks of the general form: opening, between role and text, closing.
    general: tuple[str, str, str]
    #: State -> roles that may come next. The state is the last role, or "start".
    order: dict[str, tuple[str, ...]]
    #: States in which a conversation may end.
    ends: tuple[str, ...]

    @cached_property
    def control(self) -> list[str]:
        return sorted({m for t in self.turns.values() for m in (t.open, t.close)} | {*self.general}, key=lambda m: (-len(m), m))

    @cached_property
    def _escapes(self) -> re.Pattern:
        return re.compile(r"\\|(?=" + "|".join(map(re.escape, self.control)) + ")")

    @cached_property
    def tokens(self) -> re.Pattern:
        return re.compile(r"\\(.)|(" + "|".join(map(re.escape, self.control)) + ")", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._escapes.sub(r"\\\g<0>", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of one turn."""
        if turn := self.turns.get(role):
            return [(turn.open, False), (self.escape(text), turn.loss), (turn.close, False)]
        first, between, last = self.general
        return [(first + self.escape(role) + between, False), (self.escape(text), False), (last, False)]


#: The template of the registered query.
INSTRUCT = Template(
    turns={"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)},
    general=("<<ROLE>>", "<<TEXT>>", "<</ROLE>>"),
    order={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


class Reader:
    """Reads formatted text back, piece by piece, into turns."""

    def __init__(self, template: Template):
        self.template, self.rest = template, ""
        self.opens = {t.open: (role, t) for role, t in template.turns.items()}

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn that this piece completes."""
        self.rest += text
        general = self.template.general
        while self.rest:
            marks = [m for m in self.template.tokens.finditer(self.rest) if m[2]]
            if len(marks) < 2:
                return
            if marks[0].start():
                raise ValueError("text outside a turn")
            if marks[0][2] == general[0]:
                if len(marks) < 3:
                    return
                role, body, close = self.rest[marks[0].end() : marks[1].start()], self.rest[marks[1].end() : marks[2].start()], marks[2]
                good = (marks[1][2], close[2]) == general[1:]
            else:
                role, turn = self.opens[marks[0][2]]
                body, close = self.rest[marks[0].end() : marks[1].start()], marks[1]
                good = close[2] == turn.close
            if not good:
                raise ValueError(f"a turn closed by {close[2]}")
            self.rest = self.rest[close.end() :]
            yield self.template.unescape(role), self.template.unescape(body)


class Order:
    """The state machine: feed it roles, then ask for the fault."""

    def __init__(self, template: Template):
        self.template, self.state, self.fault, self.count = template, "start", None, 0

    def feed(self, role: str) -> None:
        if self.fault is None and role not in self.template.order.get(self.state, ()):
            self.fault = f"turn {self.count}: {role!r} after {self.state!r}" if role in self.template.turns else f"turn {self.count}: unknown role {role!r}"
        self.state, self.count = role, self.count + 1

    def end(self) -> str | None:
        if self.fault is None and self.state not in self.template.ends:
            self.fault = f"ends after {self.state!r}"
        return self.fault


SEGMENTS = "conv_id long, segment long, text string, loss boolean, fault string, last boolean"


def format_turns(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments of every conversation: conv_id, segment (number from 0), text, loss, fault, last.

    ``last`` marks an empty segment that closes a conversation; its ``fault`` says what is wrong
    with the turn order, or is null.
    """
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, key, number, order = False, None, 0, Order(template)
        for batch in batches:
            rows: list[tuple] = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_ or conv != key:
                    if open_:
                        rows.append((key, number, "", False, order.end(), True))
                    open_, key, number, order = True, conv, 0, Order(template)
                order.feed(role or "")
                for said, loss in template.segments(role or "", text or ""):
                    rows.append((key, number, said, loss, None, False))
                    number += 1
            if rows:
                yield batch_of(rows)
        if open_:
            yield batch_of([(key, number, "", False, order.end(), True)])

    chosen = turns.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("n"), F.col("role").alias("r"), F.col("text").alias("t"))
    ordered = chosen.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")
    return ordered.mapInArrow(run, SEGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, fault string"


def read_digests(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, all read back from the segments, which stand in order within partitions."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> dict:
            return {"reader": Reader(template), "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}

        now = fresh()
        for batch in batches:
            rows: list[tuple] = []
            for conv, text, loss, fault, last in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
                now["chars"] += len(text)
                if loss:
                    plain = template.unescape(text)
                    now["loss_chars"] += len(plain)
                    now["loss"].update(plain.encode("utf-8", "surrogatepass"))
                for role, said in now["reader"].feed(text):
                    now["turns"] += 1
                    now["all"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if last:
                    if now["reader"].rest:
                        raise ValueError("a conversation that ends within a turn")
                    rows.append((conv, now["turns"], now["all"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"], fault is None, fault))
                    now = fresh()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return segments.mapInArrow(run, DIGESTS)
