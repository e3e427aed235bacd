"""Token ids in files of directly addressable codes.

An id is split into chunks, low bits first, one level for each chunk. A level holds the chunks
of those ids that reach it, and a bitmap of the ids that go on to the next; a directory of
the bits set before each block makes ranks cheap. So any token is read without decoding
others: its place on the next level is the rank of its bit.

The file format is a Parquet table of segments. A segment is the ids of documents in ascending
order of ``doc_id``, up to ``SEGMENT_TOKENS`` of them or one longer document; the binary cell is

    b"DAC1", uint64 ids, uint32 levels, then for each level uint32 width in bytes,
    uint64 chunks, the chunks, and but for the last level the bitmap (little bit order, in
    whole blocks) and uint64 ranks at the block starts.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .texts import slices, text_rows, utf8
from .tokenizer_files import vocabulary

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
WIDTHS = (1, 1, 2)
BLOCK_BITS = 512
SEGMENT_TOKENS = 1 << 18
CACHED_PIECES = 1_000_000
# Bytes of text whose distinct pieces are found at a time.
SLICE_BYTES = 4_000_000
SPACES = b" \t\n\r"
PUNCTUATION = b".,;:!?\"#$%&()*+-/<=>@[\\]^_`{}~"
# What a byte may be; LEAD and SECOND are those of U+00C0 to U+00FF, U+0140 to U+01BF and U+0400 to
# U+047F: letters in either case, but U+00D7 and U+00F7, whose second bytes are left out. (Of those
# between, U+0130 is a letter and a mark in lower case.)
_SPACE, _PUNCTUATION, _ALNUM, _LEAD, _SECOND = 1, 2, 4, 8, 16
_KINDS = bytes(
    _SPACE * (byte in SPACES)
    | _PUNCTUATION * (byte in PUNCTUATION)
    | _ALNUM * (byte < 128 and chr(byte).isalnum())
    | _LEAD * (byte in b"\xc3\xc5\xc6\xd0\xd1")
    | _SECOND * (0x80 <= byte < 0xC0 and byte not in b"\x97\xb7")
    for byte in range(256)
)
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """The cell of a segment with these ids."""
    rest = ids.astype(np.uint64)
    out = [b"DAC1", struct.pack("<QI", len(ids), len(WIDTHS))]
    for level, width in enumerate(WIDTHS):
        bits = np.uint64(8 * width)
        chunks = (rest & np.uint64((1 << 8 * width) - 1)).astype(f"<u{width}")
        out += [struct.pack("<IQ", width, len(chunks)), chunks.tobytes()]
        rest >>= bits
        if level < len(WIDTHS) - 1:
            goes_on = rest > 0
            bitmap = np.packbits(goes_on, bitorder="little")
            blocks = -(-len(chunks) // BLOCK_BITS)
            bitmap = np.pad(bitmap, (0, blocks * BLOCK_BITS // 8 - len(bitmap)))
            counts = _POPCOUNT[bitmap].reshape(blocks, BLOCK_BITS // 8).sum(axis=1, dtype=np.uint64)
            out += [bitmap.tobytes(), (np.cumsum(counts, dtype=np.uint64) - counts).tobytes()]
            rest = rest[goes_on]
    return b"".join(out)


class Segment:
    """Random access to the ids of a cell."""

    def __init__(self, cell: bytes):
        if cell[:4] != b"DAC1":
            raise ValueError("not a segment of token ids")
        self.size, levels = struct.unpack_from("<QI", cell, 4)
        at, self.levels = 16, []
        for level in range(levels):
            width, n = struct.unpack_from("<IQ", cell, at)
            chunks = np.frombuffer(cell, f"<u{width}", n, at + 12)
            at += 12 + n * width
            bitmap = ranks = None
            if level < levels - 1:
                blocks = -(-n // BLOCK_BITS)
                bitmap = np.frombuffer(cell, np.uint8, blocks * BLOCK_BITS // 8, at)
                at += len(bitmap)
                ranks = np.frombuffer(cell, "<u8", blocks, at)
                at += 8 * blocks
            self.levels.append((8 * width, chunks, bitmap, ranks))

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Bits set before place ``i``."""
        block = min(i // BLOCK_BITS, len(ranks) - 1)
        if block < 0:
            return 0
        first = block * BLOCK_BITS // 8
        whole = int(_POPCOUNT[bitmap[first : i // 8]].sum())
        part = _POPCOUNT[bitmap[i // 8] & ((1 << i % 8) - 1)] if i % 8 else 0
        return int(ranks[block]) + whole + int(part)

    def token(self, i: int) -> int:
        """The id at place ``i``."""
        value = shift = 0
        for bits, chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += bits
            if bitmap is None or not bitmap[i // 8] >> i % 8 & 1:
                return value
            i = self._rank(bitmap, ranks, i)
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to before ``stop``, reading nothing outside them."""
        values = np.zeros(stop - start, dtype=np.uint32)
        places, shift = np.arange(stop - start), 0
        for bits, chunks, bitmap, ranks in self.levels:
            values[places] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            shift += bits
            if bitmap is None or not len(places):
                break
            window = np.unpackbits(bitmap[start // 8 : -(-stop // 8)], bitorder="little")
            goes_on = window[start % 8 : start % 8 + stop - start].astype(bool)
            places = places[goes_on]
            start = self._rank(bitmap, ranks, start)
            stop = start + len(places)
        return values


class WordBpe:
    """The library's tokenizer, asked once for each distinct piece of text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # Pieces by number: the ids of all on end, and where those of each begin.
        self.numbers: dict[str, int] = {}
        self.ids = np.zeros(0, dtype="<u4")
        self.starts = np.zeros(1, dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and how many each has. Texts are cut where no match of
        the tokenizer goes on, and Python sees each distinct piece only."""
        if len(self.numbers) > CACHED_PIECES:
            self._forget()
        # A copy of its own, as Arrow folds the case of a slice at wrong places.
        texts = pa.concat_arrays([texts[:0], texts]).cast(pa.large_string())
        # The tokenizer takes no note of case, but for what may be a special token's name.
        special = pc.match_substring(texts, "<|")
        pieces, bounds = _cut(pc.if_else(special, texts, pc.ascii_lower(texts)))
        coded = pieces.dictionary_encode()
        # No piece holds a space, and cutting one string is cheaper than making many of Arrow's.
        one = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        joined = pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_py()
        distinct = joined.split(" ") if len(pieces) else []
        known = np.fromiter(map(self.numbers.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(known < 0)
        if len(unknown):
            new = [distinct[i] for i in unknown.tolist()]
            self._learn(new)
            known[unknown] = np.fromiter(map(self.numbers.__getitem__, new), np.int64, len(new))
        starts, sizes = self.starts[known], self.starts[known + 1] - self.starts[known]
        indices = np.asarray(coded.indices)
        sizes = sizes[indices]
        ends = np.cumsum(sizes)
        first = np.repeat(starts[indices] - (ends - sizes), sizes)
        first += np.arange(len(first))
        return self.ids[first], np.diff(np.concatenate([[0], ends])[bounds])

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces: words of letters many at a time, as the last id of each is one
        of a word's end; the others one by one."""
        words = [piece for piece in pieces if piece.isalpha()]
        rest = [piece for piece in pieces if not piece.isalpha()]
        groups = [words[i : i + 100] for i in range(0, len(words), 100)]
        learnt, ids, sizes = [], [self.ids], []
        for group, found in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.ends[found]) + 1
            if len(ends) == len(group):
                learnt += group
                ids.append(found)
                sizes.append(np.diff(ends, prepend=0))
            else:
                rest += group
        found = self._encode(rest)
        learnt += rest
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        self.numbers.update(zip(learnt, count(len(self.numbers)), strict=False))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])
        self.ids = np.concatenate([*ids, *found])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, dtype="<u4") for one in found]


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts on end, without spaces between, and the first of each text (one more
    at the end).

    Cuts are at spaces, between a letter or digit and punctuation after it, and between
    punctuation and an ASCII letter or digit after it. Only ``'`` can match together with a
    letter and only ``|`` lies beside the letters of a special token, so nothing is cut there.
    """
    data, bounds = utf8(texts)
    plain = data.tobytes()
    kinds = np.frombuffer(plain.translate(_KINDS), np.uint8)
    inside = (kinds & _SPACE) == 0
    # At the last byte of a letter or digit: ASCII, or of the letters with two bytes.
    ended = (kinds & _ALNUM) > 0
    ended[1:] |= ((kinds[:-1] & _LEAD) > 0) & ((kinds[1:] & _SECOND) > 0)
    punctuation = (kinds & _PUNCTUATION) > 0
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:-1] = ended[:-1] & punctuation[1:]
    begins[1:-1] |= punctuation[:-1] & ((kinds[1:] & _ALNUM) > 0)
    begins[1:-1] |= ~inside[:-1]
    begins[bounds] = True
    begins = begins[:-1] & inside
    offsets = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside))
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(plain.translate(None, SPACES))]
    pieces = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers)
    return pieces, np.searchsorted(np.flatnonzero(begins), bounds)


_loaded: dict[str, WordBpe] = {}


def load(name: str) -> WordBpe:
    if name not in _loaded:
        _loaded[name] = WordBpe(vocabulary(name))
    return _loaded[name]


def write(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID
) -> None:
    """Encode every document, append ``end_id``, and write the ids to ``path`` in ascending
    order of ``doc_id``.

    Null texts count as empty and have the end id alone. A null id comes before all others;
    equal ids are ordered by text, and each row is written. Other columns are not read. Cut
    points from a distributed quantile sketch of the ids deal out the rows, so no task
    sorts more than its share.
    """
    rows = text_rows(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / parts for i in range(1, parts)]
    cuts = sorted(set(docs.approxQuantile("doc_id", steps, 0.1 / parts))) if steps else []
    # How many cuts lie below an id: as many as a sorted array has elements below it.
    marks = F.array(*[F.lit(int(cut)) for cut in cuts]).cast("array<bigint>")
    below = F.size(F.filter(marks, lambda cut: cut < F.col("doc_id")))
    dealt = rows.withColumn("bucket", F.coalesce(below, F.lit(0)))
    sorted_rows = dealt.repartitionById(parts, F.col("bucket")).sortWithinPartitions(
        "bucket", "doc_id", "text"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = load(vocabulary), np.array([end_id], "<u4").tobytes()
        names = ["bucket", "part", "n_tokens", "doc_ids", "starts", "codes"]
        bucket, part, held, size = None, 0, [], 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            sizes = np.array([len(x) // 4 for _, x in held])
            row = [bucket, part, len(ids), [d for d, _ in held], np.cumsum(sizes) - sizes, pack(ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            cells = [pa.array([x], k) for x, k in zip(row, [*kinds, pa.binary()], strict=True)]
            return pa.RecordBatch.from_arrays(cells, names=names)

        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE_BYTES):
                some = batch.slice(start, stop - start)
                flat, counts = bpe.encode(some.column(1))
                stops = (4 * np.cumsum(counts)).tolist()
                whole = flat.tobytes()
                keys = zip(some.column(0).to_pylist(), some.column(2).to_pylist(), strict=True)
                for (doc, place), first, stop in zip(keys, [0, *stops], stops, strict=False):
                    ids = whole[first:stop]
                    if held and (place != bucket or size + len(ids) // 4 >= SEGMENT_TOKENS):
                        yield segment()
                        part, held, size = part + 1 if place == bucket else 0, [], 0
                    bucket = place
                    held.append((doc, ids + end))
                    size += len(ids) // 4 + 1
        if held:
            yield segment()

    made = sorted_rows.mapInArrow(
        run,
        "bucket int, part int, n_tokens bigint, doc_ids array<bigint>, starts array<bigint>, "
        "codes binary",
    )
    made.write.parquet(path)


def read(segments: DataFrame, *columns: Column) -> DataFrame:
    """Each document of the files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids`` as little-endian unsigned 32-bit integers.

    With ``columns``, these are returned in place of ``ids``, of which they are made before
    documents meet the offsets of their segments, so no ids are shuffled.
    """
    sizes = segments.select("bucket", "part", "n_tokens")
    buckets = sizes.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_bucket"))
    inside = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.select(
        "bucket", "part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_part")
    )
    index = within.join(offsets, "bucket").select(
        "bucket", "part", (F.col("_bucket") + F.col("_part")).alias("first")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "part", "doc_id", "at", "n_tokens", "ids"]
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, part, n, docs, starts, codes = (c[i].as_py() for c in batch.columns)
                held, stops = Segment(codes), [*starts[1:], n]
                ids = [held.tokens(a, b).astype("<u4").tobytes() for a, b in zip(starts, stops)]
                cells = [
                    pa.array([bucket] * len(docs), pa.int32()),
                    pa.array([part] * len(docs), pa.int32()),
                    pa.array(docs, pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cells, names=names)

    cells = segments.select("bucket", "part", "n_tokens", "doc_ids", "starts", "codes")
    documents = cells.mapInArrow(
        run, "bucket int, part int, doc_id bigint, at bigint, n_tokens bigint, ids binary"
    )
    wanted = documents.select("bucket", "part", "doc_id", "at", "n_tokens", *(columns or ["ids"]))
    joined = wanted.join(index, ["bucket", "part"])
    return joined.withColumn("start", F.col("first") + F.col("at")).select(
        "doc_id", "start", "n_tokens", *wanted.columns[5:]
    )
