"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns up to and with it, of which only its text is
trainable.  A conversation that does not end in an assistant turn gets one more row without a trainable span, so
that nothing of it is lost and the output can be read back whole.

The template writes a turn as ``### role: text</turn>`` and a line feed.  Inside texts a backslash, a ``###`` and
a ``</turn>`` are escaped with a backslash, inside roles also every colon, so no text can end its turn or open
another one, and reading back is exact.

A conversation is read as a sorted stream, and a task holds its rendered prefix, which is what a single output row
holds, never its rows.  A conversation is one task: each of its examples holds all that is before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.columns import bound_batches

_ESCAPE_TEXT = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPE_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
#: Characters gathered before a batch of examples is handed on.
_FLUSH = 4 << 20


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends in it."""
    head = f"### {_ESCAPE_ROLE.sub(r'\\\g<0>', role or '')}: "
    body = _ESCAPE_TEXT.sub(r"\\\g<0>", text or "")
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The ``(role, text)`` turns of a formatted example."""
    at = 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"no turn at character {at}")
        yield unescape(turn[1]), unescape(turn[2])
        at = turn.end()


def format_conversations(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """``(conv_id, example, text, loss_start, loss_end)``: examples numbered from 0 within a conversation.

    ``loss_start`` and ``loss_end`` are code points of ``text``; both are null in the row that only preserves turns
    after the last trainable one.  ``turns`` needs ``conv_id``, ``turn``, ``role`` and ``text``; other columns are
    ignored.  Turns come in order of ``turn`` (null first), then role and text; repeated rows are turns of their
    own.  Null roles and texts are empty; rows with a null ``conv_id`` are one conversation.  An empty table gives
    no rows.  Examples of a conversation come out in order within one partition.
    """
    bound_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, example int, text string, loss_start long, loss_end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, prefix, number, trained, rows, held, type_ = None, "", 0, True, [], 0, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = (type_, pa.int32(), pa.string(), pa.int64(), pa.int64())
            names = ("conv_id", "example", "text", "loss_start", "loss_end")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            type_ = batch.schema.field(0).type
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (key,) != conv:
                    if not trained:
                        rows.append((conv[0], number, prefix, None, None))
                        held += len(prefix)
                    conv, prefix, number = (key,), "", 0
                turn, begin, end = render(role, text)
                at, prefix, trained = len(prefix), prefix + turn, role == target_role
                if trained:
                    rows.append((key, number, prefix, at + begin, at + end))
                    number, held = number + 1, held + len(prefix)
                if held > _FLUSH:
                    yield batch_of(rows)
                    rows, held = [], 0
        if not trained:
            rows.append((conv[0], number, prefix, None, None))
        if rows:
            yield batch_of(rows)

    dealt = turns.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, schema)


def read_back(examples: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests per conversation, from the text of ``format_conversations`` alone.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``: turns as role, line feed, text,
    line feed; trainable text of all examples in order; ``formatted_chars`` is the length of all its examples.
    Every example must begin with the whole one before it, else reading fails, and so do repeated examples.  Null ids
    are one conversation; an empty table gives no rows.  With ``in_order`` the examples are taken to come as
    ``format_conversations`` returns them, and nothing is shuffled; tables that were written and read again do not.
    """
    kind = examples.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, loss, chars, total, type_ = None, "", None, 0, 0, None

        def result() -> tuple:
            digest, n = hashlib.sha256(), 0
            for role, text in read_turns(last):
                digest.update(f"{role}\n{text}\n".encode())
                n += 1
            return conv[0], n, digest.hexdigest(), chars, loss.hexdigest(), total

        for batch in batches:
            type_, rows = batch.schema.field(0).type, []
            for key, text, begin, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if (key,) != conv:
                    if conv:
                        rows.append(result())
                    conv, last, loss, chars, total = (key,), "", hashlib.sha256(), 0, 0
                if not text.startswith(last) or len(text) == len(last):
                    raise ValueError(f"an example of conversation {key} does not continue the one before it")
                last, total = text, total + len(text)
                if begin is not None:
                    span = unescape(text[begin:end])
                    loss.update(span.encode())
                    chars += len(span)
            if rows:
                yield batch_of(rows, type_)
        if conv:
            yield batch_of([result()], type_)

    def batch_of(rows: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
        types = (type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    examples = examples.select("conv_id", "example", "text", "loss_start", "loss_end")
    if not in_order:
        examples = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    bound_batches(examples.sparkSession)
    return examples.mapInArrow(run, schema)
