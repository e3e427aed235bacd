"""Texts in Arrow batches: plain columns in, slices of bounded size, words as hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1_000_000


def text_rows(docs: DataFrame, *more: str, text: str = "text") -> DataFrame:
    """Only the columns an operator reads, null texts as empty ones."""
    columns = [docs[name] for name in more]
    return docs.select(*columns, F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def schema_of(rows: DataFrame, keys: Sequence[str], **more: str) -> T.StructType:
    """The key columns as they are in ``rows``, and more columns by name and type."""
    schema = T.StructType([rows.schema[name] for name in keys])
    for name, kind in more.items():
        schema = schema.add(name, kind)
    return schema


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each; a longer text is one by itself."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start, n = 0, len(sizes)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, base + limit, side="right"))
        stop = max(start + 1, stop)
        yield start, stop
        start = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins (one more at the end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    joined = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    return joined, bounds - bounds[0]


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits of the result depend on all bits given."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15 | 5
_BACK = pow(_STEP, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, step in enumerate((_STEP, _BACK)):
                factors = np.full(n, step, dtype=np.uint64)
                factors[0] = 1
                _powers[i] = np.cumprod(factors)
    return _powers


def word_hashes(
    data: np.ndarray, bounds: np.ndarray, separator: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and each text's first word (one more at the end).

    ``separator`` says for each of the 256 bytes whether it parts words. A-Z count as a-z.
    A word's polynomial is a difference of running sums, so no word is ever cut out.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    forth, back = _power_tables(n + 1)
    inside = ~separator[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    lower = data + np.where((data >= 65) & (data <= 90), 33, 1).astype(np.uint16)
    with np.errstate(over="ignore"):
        running = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(lower * forth[:n], out=running[1:])
        words = (running[ends] - running[starts]) * back[starts]
    return mix(words + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


def separators(parting: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(parting)] = True
    return table


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, texts ignored."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    count = len(words) - size + 1
    total = words[:count].copy()
    with np.errstate(over="ignore"):
        for i in range(1, size):
            total *= np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(32)
            total += words[i : i + count]
    return mix(total)
