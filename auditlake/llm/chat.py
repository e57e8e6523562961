"""Chat formatting with turn spans found by incremental rendering.

A template is a black box: it renders a list of turns to a string. The turns' spans come from rendering successive prefixes
and comparing consecutive outputs: the text that a turn adds is its span. If an output doesn't begin with the one before, the template
rewrites history, and ``RewritesHistory`` is raised.

Rendering every prefix of a long conversation whole would cost the square of its length. A template may
state its ``context``, the number of turns before a turn on which its rendering depends; then prefixes are
rendered within windows of turns that overlap by the context, and time and memory stay proportional. Without
it, whole prefixes are rendered.

Texts are escaped reversibly: the backslash is doubled, and one is put after the first character of every control string, so no
control string of the template is left inside a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import by_name

#: Control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
WINDOW = 16

_CONTROL = re.compile("\\\\|" + "|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(\\?)", re.DOTALL)

Turn = tuple[str, str]


class RewritesHistory(ValueError):
    """A template changed text it had given for earlier turns."""


@dataclass(frozen=True)
class Template:
    render: Callable[[list[Turn]], str]
    context: int | None = None


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(turns: list[Turn]) -> str:
    """The default template: one stretch per turn, marked by control strings; a turn depends on no other."""
    out = []
    for role, text in turns:
        t = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {t} [/INST]")
        elif role == "assistant":
            out.append(f" {t} </s>")
        elif role == "system":
            out.append(f"<<SYS>> {t} <</SYS>>")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE] {t} </s>")
    return "".join(out)


DEFAULT = Template(render, context=0)
#: One turn of the default template: mark, role, text, mark.
_TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>> (?P<system>.*?) <</SYS>>"
    r"|\[ROLE\](?P<role>.*?)\[/ROLE\] (?P<other>.*?) </s>| (?P<assistant>.*?) </s>", re.DOTALL)


def read_back(piece: str) -> tuple[str, str, int, int]:
    """(role, text, start and end of the escaped text) of one formatted turn of the default template."""
    m = _TURN.fullmatch(piece)
    if not m:
        raise ValueError("not a turn of this template")
    kind = next(k for k in ("user", "system", "assistant", "other") if m[k] is not None)
    role = unescape(m["role"]) if kind == "other" else kind
    return role, unescape(m[kind]), m.start(kind), m.end(kind)


def turn_pieces(turns: Iterator[Turn], template: Template = DEFAULT, window: int = WINDOW) -> Iterator[str]:
    """The text that every turn adds to the conversation, from outputs of successive prefixes."""
    held: list[Turn] = []
    before = template.render([])
    if before:
        raise RewritesHistory("the template renders no turns to text")
    for turn in turns:
        if template.context is not None and len(held) >= window + template.context:
            held = held[len(held) - template.context :]
            before = template.render(held)
        held.append(turn)
        now = template.render(held)
        if not now.startswith(before):
            raise RewritesHistory(f"turn {len(held)} changed what was rendered before")
        yield now[len(before) :]
        before = now


def format_turns(
    conversations: DataFrame, template: Template = DEFAULT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per turn, in order within its conversation: conv_id, position, role, text, formatted, start, trained.

    ``formatted`` is the turn's stretch of the formatted conversation, which begins at code point ``start``; ``trained`` tells
    whether it is under the loss mask (the assistant's turns). The rows of a conversation come in order and in one
    partition, and are handled as a stream, so a conversation of any length takes little memory. Null texts and roles are empty; ties
    of the turn number are ordered by role and text; a null id is a conversation of its own.
    """
    rows = conversations.select(
        by_name(conversations, conv_id).cast("long").alias("conv_id"), by_name(conversations, turn).cast("long").alias("turn"),
        F.coalesce(by_name(conversations, role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(by_name(conversations, text).cast("string"), F.lit("")).alias("text"))
    # A chain of turns is in order by nature (digests and prefixes run through it), so a conversation stays together.
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in conversations_of(batches, 4):
            conv, position, start, pending = None, 0, 0, []
            texts: list = []

            def turns(group=group, texts=texts):
                for c, _, r, t in group:
                    texts.append((c, r, t))
                    yield r, t

            for piece in turn_pieces(turns(), template):
                conv, r, t = texts.pop(0)
                pending.append((conv, position, r, t, piece, start, r == "assistant"))
                position, start = position + 1, start + len(piece)
                if len(pending) >= 256:
                    yield _rows(pending)
                    pending = []
            if pending:
                yield _rows(pending)

    kind = "conv_id long, position long, role string, text string, formatted string, start long, trained boolean"
    return ordered.mapInArrow(run, kind)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_())
    names = ("conv_id", "position", "role", "text", "formatted", "start", "trained")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def conversations_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Iterator[tuple]]:
    """Streams of rows with the same first column, which must be read in order and to their end."""

    def rows():
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield from zip(*(part.column(k).to_pylist() for k in range(width)), strict=True)

    source = rows()
    ahead = next(source, None)

    def one(key):
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            row, ahead = ahead, next(source, None)
            yield row

    while ahead is not None:
        group = one(ahead[0])
        yield group
        for _ in group:  # whatever the caller left
            pass


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted turns alone: counts and digests of turns and of text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for group in conversations_of(batches, 3):
            all_turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            conv = None
            for conv, piece, trained in group:
                role, text, _, _ = read_back(piece)
                n, chars = n + 1, chars + len(piece)
                all_turns.update(f"{role}\n{text}\n".encode())
                if trained:
                    loss_chars += len(text)
                    loss.update(text.encode())
            out.append((conv, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 1024:
                yield _digest_rows(out)
                out = []
        if out:
            yield _digest_rows(out)

    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "trained").mapInArrow(run, kind)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
