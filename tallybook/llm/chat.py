"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to a string.  The
turns of a conversation are rendered prefix by prefix; what one more turn adds to
the output is that turn's span.  An output that does not begin with the one
before it belongs to a template that rewrites history.  Where a text lies inside
its span is found by rendering the last turn twice with different one-letter texts:
what the two outputs share before and after is the template's own.

Conversations arrive sorted and are streamed.  A template that looks back at most
``context`` turns is rendered in blocks of ``block`` turns, each after the last
``context`` turns of the block before, so that a conversation of any length is
held a block at a time and costs time in proportion; the first turn opens the
first block.  With ``context=None``, the default for any template, every prefix is rendered
whole, at a cost that grows with the square of the conversation; a template may only be
given another ``context`` by who knows how far it looks back, as ``digest`` does for ``instruct``.

Defined results: null text and null role are empty.  Rows are ordered by turn
(nulls first), then role, then text; rows that repeat a turn are turns of their own.
Rows without ``conv_id`` form one conversation.  Only ``conv_id``, ``turn``, ``role``
and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the built-in template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SPECIAL = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n(.*?)</s>", re.S)
INSIDE = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>")}

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]
PIECES = "conv_id long, position long, role string, piece string, start long, text_start long, text_end long, in_loss boolean, rewrites boolean"
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"
)


def escape(text: str) -> str:
    """Breaks each control string with a backslash after its first character; a backslash is doubled."""
    return SPECIAL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def instruct(turns: Turns) -> str:
    """``<s>role``, a line end, the text (in marks of its role), ``</s>``, for each turn."""
    out = []
    for role, text in turns:
        before, after = INSIDE.get(role, ("", ""))
        name = escape(role).replace("\n", "\\\n")
        out.append(f"<s>{name}\n{before}{escape(text)}{after}</s>")
    return "".join(out)


def read_back(formatted: str) -> Turns:
    """The turns of what ``instruct`` wrote."""
    turns = []
    for m in TURN.finditer(formatted):
        role = unescape(m[1])
        before, after = INSIDE.get(role, ("", ""))
        turns.append((role, unescape(m[2][len(before) : len(m[2]) - len(after)])))
    return turns


@dataclass(frozen=True)
class Piece:
    """What a turn adds to the output, and where the text lies in it; no places if history was rewritten."""

    position: int
    role: str
    piece: str
    text_start: int | None
    text_end: int | None
    rewrites: bool


def _around(template: Template, before: Turns, role: str) -> tuple[int, int]:
    """Lengths of what precedes and follows the text of one more turn (the first counted from the output's start)."""
    a, b = template([*before, (role, "A")]), template([*before, (role, "B")])
    head = len(os.path.commonprefix([a, b]))
    tail = len(os.path.commonprefix([a[:head:-1], b[:head:-1]])) if len(a) > head else 0
    return head, tail


def rendered(turns: Iterable[tuple[str, str]], template: Template, context: int | None, block: int) -> Iterator[Piece]:
    """The pieces of one conversation, in order."""
    seen: Turns = []
    output = template([])
    fresh = 0
    for position, (role, text) in enumerate(turns):
        if context is not None and fresh >= block:
            seen = seen[len(seen) - context :] if context else []
            output, fresh = template(seen), 0
        longer = template([*seen, (role, text)])
        if longer.startswith(output):
            head, tail = _around(template, seen, role)
            yield Piece(position, role, longer[len(output) :], head - len(output), len(longer) - tail - len(output), False)
        else:
            yield Piece(position, role, longer[len(os.path.commonprefix([longer, output])) :], None, None, True)
        seen.append((role, text))
        output = longer
        fresh += 1


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """(conv_id, turns) of sorted rows; turns must be used up before the next conversation."""
    rows = (row for b in batches for row in zip(*(b.column(c) for c in ("conv_id", "role", "text")), strict=True))
    row = next(rows, None)

    def turns(conv):
        nonlocal row
        while row is not None and row[0].as_py() == conv:
            yield row[1].as_py() or "", row[2].as_py() or ""
            row = next(rows, None)

    while row is not None:
        conv = row[0].as_py()
        yield conv, turns(conv)


def _by_conversation(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_turns(
    conversations: DataFrame,
    template: Template = instruct,
    context: int | None = None,
    block: int = 64,
    trained: tuple[str, ...] = ("assistant",),
    rows_out: int = 4096,
) -> DataFrame:
    """One row per turn: its piece of the formatted conversation, where the piece begins,
    the span of the text in the piece, whether the span is under the loss mask."""

    def run(batches):
        waiting: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*waiting, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            names = [c.split()[0] for c in PIECES.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            waiting.clear()
            return out

        for conv, turns in _conversations(batches):
            start = 0
            for p in rendered(turns, template, context, block):
                masked = p.role in trained and not p.rewrites
                waiting.append((conv, p.position, p.role, p.piece, start, p.text_start, p.text_end, masked, p.rewrites))
                start += len(p.piece)
                if len(waiting) == rows_out:
                    yield batch()
        if waiting:
            yield batch()

    return _by_conversation(conversations).mapInArrow(run, PIECES)


def digest(
    conversations: DataFrame, context: int | None = 0, block: int = 64, trained: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """Formats with ``instruct`` and reads the turns back from the output: counts and digests per conversation."""

    def run(batches):
        for conv, turns in _conversations(batches):
            whole, loss = hashlib.sha256(), hashlib.sha256()
            count = chars = loss_chars = 0
            rewrites = False
            for p in rendered(turns, instruct, context, block):
                for role, text in read_back(p.piece):
                    whole.update(f"{role}\n{text}\n".encode())
                    count += 1
                chars += len(p.piece)
                rewrites |= p.rewrites
                if p.role in trained and not p.rewrites:
                    masked = unescape(p.piece[p.text_start : p.text_end])
                    loss.update(masked.encode())
                    loss_chars += len(masked)
            values = [conv, count, whole.hexdigest(), loss_chars, loss.hexdigest(), chars, rewrites]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            names = [c.split()[0] for c in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    return _by_conversation(conversations).mapInArrow(run, DIGEST)
