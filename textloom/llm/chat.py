"""Chat formatting by grammar round trip: rendered text is parsed again and escaped until nothing is lost."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.runtime import small_batches

# The template: "### Role: text </turn>\n". A control string in a text is escaped by a backslash in front.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_ROLE = re.compile(r"((?:[^\\:]|\\.)*): ", re.S)
_NEXT = re.compile(r"\\(?:\\|###|</turn>)|###|</turn>\n?")


def escape(text: str, level: int) -> str:
    """Level 0 leaves text alone, 1 escapes control strings, 2 backslashes too; level 2 always comes back."""
    if level == 2:
        text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: "\\" + m[0], text) if level else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Parser:
    """A deterministic parser of rendered turns; feed() takes the text in any pieces."""

    rest: str = ""
    at: int = 0
    turns: list[tuple[str, str, int, int]] = field(default_factory=list)

    def feed(self, text: str) -> list[tuple[str, str, int, int]]:
        """(role, text, start, end) of the turns that are complete now; start and end are of the raw text."""
        self.rest += text
        out, at = [], 0
        while (head := _match_header(self.rest, at)) and (close := _close(self.rest, head[1])):
            role, body = head
            out.append((role, unescape(self.rest[body : close - 1]), self.at + body, self.at + close - 1))
            at = close + len(CLOSE) - 1
        self.rest, self.at = self.rest[at:], self.at + at
        return out


def _match_header(text: str, at: int) -> tuple[str, int] | None:
    if not text.startswith(OPEN, at):
        return None
    i = at + len(OPEN)
    m = _ROLE.match(text, i)
    return (re.sub(r"\\(.)", r"\1", m[1], flags=re.S), m.end()) if m else None


def _close(text: str, at: int) -> int | None:
    """Where the turn's closing mark begins; None if it isn't there, or a bare control string comes first."""
    for m in _NEXT.finditer(text, at):
        if m[0][0] != "\\":
            return m.start() if m[0] == "</turn>\n" and m.start() > at and text[m.start() - 1] == " " else None
    return None


def render(role: str, text: str, level: int) -> str:
    """One turn in the template; in a role, a backslash escapes backslash, colon and number sign."""
    return f"{OPEN}{re.sub(r'([\\:#])', r'\\\1', role)}{MIDDLE}{escape(text, level)}{CLOSE}"


def format_turn(role: str, text: str) -> tuple[str, tuple[str, str, int, int]]:
    """The rendered turn and what the parser reads in it, escaped as little as brings both back."""
    for level in range(3):
        out = render(role, text, level)
        parser = Parser()
        got = parser.feed(out)
        if len(got) == 1 and not parser.rest and got[0][:2] == (role, text):
            return out, got[0]
    raise ValueError("a turn does not come back from its template")


@dataclass
class _Reading:
    """Digests of a conversation as it is read back from its rendered text, turn by turn.

    The turns' digest is of the parsed roles and texts; the loss digest is of the raw text under the loss
    mask, unescaped. The source serves only to compare.
    """

    conv: object
    parser: Parser = field(default_factory=Parser)
    n: int = 0
    chars: int = 0
    loss: int = 0
    turns_sha: object = field(default_factory=hashlib.sha256)
    loss_sha: object = field(default_factory=hashlib.sha256)

    def add(self, rendered: str, want: tuple[str, str]) -> None:
        base, raw = self.parser.at, self.parser.rest + rendered
        self.chars += len(rendered)
        got = self.parser.feed(rendered)
        if [g[:2] for g in got] != [want]:
            raise ValueError("a turn does not come back from its conversation")
        for role, text, start, end in got:
            self.n += 1
            self.turns_sha.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                masked = unescape(raw[start - base : end - base])
                self.loss += len(masked)
                self.loss_sha.update(masked.encode())

    def row(self) -> tuple:
        return self.conv, self.n, self.turns_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars


def _ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Each conversation's turns together and in order; a long conversation streams through its task in batches."""
    small_batches(turns)
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, nth, rendered, loss_start, loss_length) per turn; a conversation's text is its turns' in order of nth.

    loss_start counts code points from the conversation's start to the turn's text under the loss mask
    (an assistant's); both are null for other turns. Texts are escaped only where they conflict.

    Turns sort by turn, then role and text, nulls first. A null text or role counts as empty; rows of a
    null conversation form one conversation; repeated rows stay, as turns of their own; no turns, no
    rows; other columns are not read. A conversation of any length needs the memory of one batch.
    """
    shape = T.StructType([T.StructField("conv", turns.schema[conv_col].dataType), *(T.StructField(n, t) for n, t in (("nth", T.LongType()), ("rendered", T.StringType()), ("loss_start", T.LongType()), ("loss_length", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nth, at = object(), 0, 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if conv != now:
                    now, nth, at = conv, 0, 0
                rendered, (_, _, start, end) = format_turn(role, text)
                mask = role == "assistant"
                out.append((nth, rendered, at + start if mask else None, end - start if mask else None))
                nth, at = nth + 1, at + len(rendered)
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True))], names=shape.fieldNames())

    return _ordered(turns, conv_col, turn_col, role_col, text_col).mapInArrow(run, shape).withColumnRenamed("conv", conv_col)


def chat_digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation what is read back from its rendered text: conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The rendered turns go through one parser per conversation, and a difference from the source fails
    the job. Cases are as format_chats() has them; digests are made in a stream, in turn order.
    """
    shape = T.StructType(
        [T.StructField("conv", turns.schema[conv_col].dataType), *(T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        now: _Reading | None = None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Reading(conv)
                now.add(format_turn(role, text)[0], (role, text))
            if out:
                yield batch_of(out)
        if now is not None:
            yield batch_of([now.row()])

    return _ordered(turns, conv_col, turn_col, role_col, text_col).mapInArrow(run, shape).withColumnRenamed("conv", conv_col)
