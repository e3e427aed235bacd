"""Chat formatting: conversations rendered by a compiled template, with generation marks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .templates import Template

# Turns stand between marks; inside a turn, the characters that marks are made of are escaped.
TEMPLATE = (
    "{% for turn in turns %}"
    "<turn {{ turn.role | escape }}>\n"
    "{% if turn.role == 'assistant' %}"
    "{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)
PIECE_CHARS = 1_000_000
_ESCAPED = str.maketrans({c: "\\" + c for c in "\\<>"})
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*+)>\n((?:[^\\<>]|\\.)*+)</turn>\n", re.S)


def escape(text: str) -> str:
    """No mark can be read in the result, and ``unescape`` gives the text again."""
    return text.translate(_ESCAPED)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Conversations as text: ``conv_id``, ``piece`` (from 0), ``formatted`` and ``spans``, the
    [start, stop) of generated text within the piece.

    Turns go by ``turn`` (null first), equal ones by role and text; repeated rows are turns
    as well. Null roles and texts are empty, a null ``conv_id`` is a conversation of its own.
    A conversation is a stream of sorted rows and comes out in pieces that end between turns,
    so one of any length passes through a task without being held there. Other columns are
    not read; no turns, no rows.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    in_order = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = Template(template, {"escape": escape}).compiled(PIECE_CHARS)
        held, size = [], 0
        for conv_id, group in groupby(_rows(batches), key=lambda row: row[0]):
            said = ({"role": role, "text": text} for _, _, role, text in group)
            for piece, out in enumerate(render({"turns": said})):
                held.append((conv_id, piece, "".join(out.parts), out.spans))
                size += out.size
                if size >= PIECE_CHARS:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    return in_order.mapInArrow(
        run,
        "conv_id bigint, piece int, formatted string, spans array<struct<start:int,stop:int>>",
    )


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _batch(held: list[tuple]) -> pa.RecordBatch:
    conv_ids, pieces, texts, spans = zip(*held, strict=True)
    marked = [[{"start": a, "stop": b} for a, b in some] for some in spans]
    columns = [
        pa.array(conv_ids, pa.int64()),
        pa.array(pieces, pa.int32()),
        pa.array(texts, pa.string()),
        pa.array(marked, _SPANS),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "piece", "formatted", "spans"])


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted piece."""
    found, at = [], 0
    for match in _TURN.finditer(formatted):
        if match.start() != at:
            break
        found.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return found


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, one row for each.

    ``n_turns``; ``turns_sha256`` over role, newline, text, newline of each turn; ``loss_chars``
    and ``loss_sha256`` of all marked text, unescaped; ``formatted_chars``.
    """
    in_order = formatted.select("conv_id", "piece", "formatted", "spans")
    in_order = in_order.repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for conv_id, group in groupby(_rows(batches), key=lambda row: row[0]):
            all_turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for _, _, text, spans in group:
                chars += len(text)
                for role, said in read_turns(text):
                    n_turns += 1
                    all_turns.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    learned = unescape(text[span["start"] : span["stop"]])
                    loss_chars += len(learned)
                    loss.update(learned.encode())
            made.append(
                (conv_id, n_turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
            )
            if len(made) == 10_000:
                yield _digest_batch(made)
                made = []
        if made:
            yield _digest_batch(made)

    return in_order.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in DIGESTS.items()))


DIGESTS = {
    "conv_id": "bigint",
    "n_turns": "bigint",
    "turns_sha256": "string",
    "loss_chars": "bigint",
    "loss_sha256": "string",
    "formatted_chars": "bigint",
}


def _digest_batch(made: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    columns = [
        pa.array(cells, kinds[kind])
        for cells, kind in zip(zip(*made, strict=True), DIGESTS.values(), strict=True)
    ]
    return pa.RecordBatch.from_arrays(columns, names=list(DIGESTS))
