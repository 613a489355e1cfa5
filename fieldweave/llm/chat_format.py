r"""Chat formatting: conversations become training texts with marks of what is learned, through compiled templates.

``formatted`` sorts the turns of each conversation within a task and streams them through a template (``chat_template``), so memory
follows a turn, not a conversation. It gives parts of about ``PART_CHARS`` characters, one for nearly every conversation, with the spans
that are under a generation mark; a conversation's text is its parts in a row. ``read_back`` takes parts, wherever they were kept, and
reads turns and marked texts out of them again.

``TEMPLATE`` opens a turn by ``### role`` and a line break and closes it by ``</turn>`` and a line break. In roles and texts a backslash
stands before each backslash, ``###`` and ``</turn>`` (in roles also before a line break), which is undone on reading.

Defined cases: turns in order of turn (null first), then role, then text; repeated rows are turns of their own; a null role or text is
empty; rows without conv_id are one conversation without id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.chat_template import Template, unescape
from fieldweave.llm.workspace import lean, partitions

PART_CHARS = 1 << 20
OUT_CHARS = 1 << 22

TEMPLATE = """{%- for message in messages -%}
{{ open }} {{ message.role | escape(open, close, '\\n') }}
{% if message.role == learned %}{% generation %}{{ message.text | escape(open, close) }}{% endgeneration %}
{%- else %}{{ message.text | escape(open, close) }}{% endif %}{{ close }}
{% endfor -%}
"""
GIVEN = {"open": "###", "close": "</turn>", "learned": "assistant"}
#: A turn as TEMPLATE writes it
TURN = re.compile(r"### ((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)

PARTS = "conv_id long, part int, formatted string, marked array<struct<start:int,end:int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns), strict=True)


def _batches(rows: Iterator[tuple], types: list[tuple[str, Any]], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each of about OUT_CHARS."""
    held: list[tuple] = []
    n = 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= OUT_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), types, strict=True)], names=[k for k, _ in types])
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), types, strict=True)], names=[k for k, _ in types])


def parts_of(pieces: Iterator[tuple[str, bool]], limit: int) -> Iterator[tuple[str, list[dict[str, int]]]]:
    """(text, marked spans) of runs of pieces; a piece is never cut."""
    out: list[str] = []
    spans: list[dict[str, int]] = []
    at = 0
    for text, marked in pieces:
        if out and at + len(text) > limit:
            yield "".join(out), spans
            out, spans, at = [], [], 0
        if marked and spans and spans[-1]["end"] == at:
            spans[-1]["end"] = at + len(text)
        elif marked:
            spans.append({"start": at, "end": at + len(text)})
        out.append(text)
        at += len(text)
    yield "".join(out), spans


def _formatter(template: Template, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv, turns in groupby(_rows(batches), key=lambda r: r[0]):
                messages = ({"role": r[1], "text": r[2]} for r in turns)
                for k, (text, spans) in enumerate(parts_of(template.pieces(messages), limit)):
                    yield conv, k, text, spans

        yield from _batches(rows(), [("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("marked", _SPANS)], lambda r: len(r[2]) + 64)

    return run


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, part, formatted and marked: the texts a template makes of ``conversations`` (conv_id, turn, role, text)."""
    spark = lean(conversations)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    turns = turns.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return turns.select("conv_id", "role", "text").mapInArrow(_formatter(template or Template(TEMPLATE, **GIVEN), PART_CHARS), PARTS)


class Reader:
    """Reads the parts of one conversation in order and sums up what it finds."""

    def __init__(self) -> None:
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, spans: list[dict[str, int]]) -> None:
        self.chars += len(text)
        for span in spans:
            learned = unescape(text[span["start"] : span["end"]])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        self.rest += text
        at = 0
        while m := TURN.match(self.rest, at):
            self.turns += 1
            self.all.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            at = m.end()
        self.rest = self.rest[at:]

    def result(self) -> tuple:
        if self.rest:
            raise ValueError(f"not a turn: {self.rest[:60]!r}")
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv, parts in groupby(_rows(batches), key=lambda r: r[0]):
            reader = Reader()
            for _, text, spans in parts:
                reader.feed(text, spans)
            yield conv, *reader.result()

    names = [c.split()[0] for c in DIGESTS.split(", ")]
    yield from _batches(rows(), [(n, pa.string() if n.endswith("256") else pa.int64()) for n in names], lambda r: 200)


def read_back(parts: DataFrame) -> DataFrame:
    """What stands in ``parts`` of TEMPLATE, by conversation: its turns and the texts under marks, unescaped."""
    spark = lean(parts)
    dealt = parts.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.select("conv_id", "formatted", "marked").mapInArrow(_reading, DIGESTS)
