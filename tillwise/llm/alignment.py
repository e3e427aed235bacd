"""Alignment of two tokenizers over one corpus, and how often ids of both end together.

Tokens of both are byte ranges of a text, and where tokens of both end, a group of tokens ends. The
two tokens that end a group are linked. One of the two is the end of the other, so the pairs that
can be linked are bounded by the bytes of the vocabularies (``Tokens.pair_bound``), not by the corpus.

Documents are encoded once and their ids stored. A first pass over these aligns the documents and
writes each task's distinct pairs with their counts. Of all distinct pairs a minimal perfect
hash is made; counts go to dense vectors at the places it gives, and the vectors of all tasks are
summed up as a tree. The second pass aligns the documents again and looks their pairs up: the
hash gives a place, the key held there verifies it.

Ids take several times the room of their texts, so they are stored in two bytes each where both
vocabularies allow it, and all passes hand rows to Python in batches of few bytes: an executor
holds such a batch twice for each of its tasks, beside the tokenizers.

Neither tokenizer has a token in which white space follows something else, so both work apart on
the two sides of a space after a character that is none. Texts are cut there; what lies between
cuts is encoded once, and kept.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import store
from .texts import SLICE_BYTES, mix, schema_of, slices, text_rows
from .tokenizer_files import vocabulary

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
SPACE = "▁"
# Characters of a text that are cut at a time, and pieces, with their characters, kept in a worker.
PART_CHARS = 1 << 20
KEPT_PIECES = 800_000
KEPT_CHARS = 1 << 25
# Pairs a task holds before it sums them up, places in one cell of a vector, and first sums.
HELD_PAIRS = 1 << 21
CELL = 1 << 16
FAN = 32
# Bytes of rows that Spark hands to Python at a time; a longer row is one batch by itself.
BATCH_BYTES = 1 << 22

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_MADE = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

_CUT = re.compile(r"(?<=\S)(?= )")


def _letters_of_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the others in ascending order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + i): byte for i, byte in enumerate(others)}


class Tokens:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a: str = BYTE_BPE, b: str = PIECE_BPE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary(a))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=vocabulary(b))
        byte = _letters_of_bytes()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            of_byte = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else None
            self.b_bytes.append(of_byte or piece.replace(SPACE, " ").encode())
        self.sizes = [
            np.array([len(token) for token in known], dtype=np.int64)
            for known in (self.a_bytes, self.b_bytes)
        ]
        self._check(json.loads(self.a.to_str()))

    def _check(self, stated: dict) -> None:
        """What cutting texts at spaces takes for granted."""
        first = stated["pre_tokenizer"] or {}
        if stated["normalizer"] or first.get("type") != "ByteLevel" or not first.get("use_regex"):
            raise ValueError("the first tokenizer has to be a plain byte-level one")
        inside = re.compile(f"[^{SPACE}]{SPACE}")
        if any(inside.search(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())):
            raise ValueError("the second tokenizer has pieces that go on after a space")

    def pair_bound(self) -> int:
        """More pairs than can be linked: each end of an id's bytes is at most one id of the
        first and, as bytes and as a piece, two of the second tokenizer."""
        return int(2 * self.sizes[0].sum() + self.sizes[1].sum())

    def width(self) -> int:
        """The bytes that hold any id of both: 2 or 4."""
        return 2 if max(map(len, self.sizes)) <= 1 << 16 else 4

    def encode(self, piece: str) -> tuple[list[int], list[int]]:
        """Ids of text that begins with a space, which the second tokenizer adds itself."""
        (a,) = self.a.encode_batch_fast([piece], add_special_tokens=False)
        b = self.b.encode(piece[1:]) if len(piece) > 1 else [self.b.piece_to_id(SPACE)]
        return a.ids, b

    def same_bytes(self, piece: str, a: Iterable[int], b: Iterable[int]) -> bool:
        said = piece.encode()
        of_a = b"".join(map(self.a_bytes.__getitem__, a))
        return of_a == said and b"".join(map(self.b_bytes.__getitem__, b)) == said


class Encoder:
    """Ids of both tokenizers for pieces of text, each encoded once and kept."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.chars = 0
        self.failed: set[int] = set()
        # The ids of all pieces on end, and where those of each begin.
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def numbered(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece. Numbers hold until the next call."""
        if len(self.numbers) > KEPT_PIECES or self.chars > KEPT_CHARS:
            self._forget()
        new = list(set(pieces).difference(self.numbers))
        if new:
            self._learn(new)
        return np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))

    def ids_of(self, side: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first (0) or second (1) ids of some pieces on end, and how many each has."""
        starts = self.starts[side]
        sizes = np.diff(starts)[numbers]
        first = np.repeat(starts[numbers] - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[side][first + np.arange(len(first))], sizes

    def _learn(self, pieces: list[str]) -> None:
        """Many at a time where white space does not end a piece, else one by one."""
        made: tuple[list, list] = ([], [])
        sizes: tuple[list, list] = ([], [])

        def add(some: list[str], both: tuple[list[int], list[int]]) -> None:
            stops = np.cumsum([len(piece.encode()) for piece in some])
            for side, ids in enumerate(both):
                held = np.array(ids, dtype=np.int64)
                ends = np.cumsum(self.tokens.sizes[side][held])
                made[side].append(held)
                sizes[side].append(np.diff(np.searchsorted(ends, stops) + 1, prepend=0))
            self.numbers.update(zip(some, range(len(self.numbers), len(self.numbers) + len(some)), strict=True))

        plain = [piece for piece in pieces if not piece[-1].isspace() and SPACE not in piece]
        for i in range(0, len(plain), 5000):
            some = plain[i : i + 5000]
            joined = "".join(some)
            both = self.tokens.encode(joined)
            if self.tokens.same_bytes(joined, *both):
                add(some, both)
        for piece in pieces:
            if piece not in self.numbers:
                both = self.tokens.encode(piece)
                if self.tokens.same_bytes(piece, *both):
                    add([piece], both)
                else:
                    self.failed.add(len(self.numbers))
                    self.numbers[piece] = len(self.numbers)
                    for side in (0, 1):
                        sizes[side].append(np.zeros(1, np.int64))
        for side in (0, 1):
            self.ids[side] = np.concatenate([self.ids[side], *made[side]])
            starts = self.starts[side]
            self.starts[side] = np.concatenate([starts, starts[-1] + np.cumsum(np.concatenate(sizes[side]))])
        self.chars += sum(map(len, pieces))


_loaded: list[Encoder] = []


def encoder() -> Encoder:
    """The worker's encoder, which keeps pieces from one task to the next."""
    if not _loaded:
        _loaded.append(Encoder(Tokens()))
    return _loaded[0]


def parts(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The pieces of texts, and the place of the text of each; of a very long text some at a time."""
    if len(texts) > 1:
        cut = [_CUT.split(f" {text}") if text else [] for text in texts]
        yield [i for i, some in enumerate(cut) for _ in some], [piece for some in cut for piece in some]
        return
    for text in texts:
        spaced, at = f" {text}", 0
        while text and at < len(spaced):
            found = _CUT.search(spaced, at + PART_CHARS)
            stop = found.start() if found else len(spaced)
            pieces = _CUT.split(spaced[at:stop])
            yield [0] * len(pieces), pieces
            at = stop


@dataclass
class PairHash:
    """A minimal perfect hash: each of n keys has a place from 0 to n - 1 of its own.

    Level by level, keys go to bits of an array twice as long as there are keys left; those
    alone at a bit stay, the others go on. A key's place is the number of bits set before its own.
    """

    levels: list[tuple[np.ndarray, np.ndarray, int]]
    keys: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> PairHash:
        levels, left, before = [], np.unique(keys).astype(np.int64), 0
        n = len(left)
        while len(left):
            size = 2 * len(left) + 63 & ~63
            at = cls._bits(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            levels.append((words, before + np.cumsum(counts) - counts, size))
            before += int(counts.sum())
            left = left[~alone[at]]
        made = cls(levels, np.full(n, -1, dtype=np.int64))
        held = np.unique(keys).astype(np.int64)
        made.keys[made._places(held)] = held
        return made

    @staticmethod
    def _bits(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            salted = keys.view(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        return (mix(salted) % np.uint64(size)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        places = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (words, ranks, size) in enumerate(self.levels):
            at = self._bits(keys[left], level, size)
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            word = words[at >> 6]
            here = (word & bit) != 0
            rank = ranks[at >> 6] + np.bitwise_count(word & (bit - np.uint64(1))).astype(np.int64)
            places[left[here]] = rank[here]
            left = left[~here]
        return places

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that was not among the keys."""
        places = self._places(keys)
        if len(self.keys):
            places[self.keys[places] != keys] = -1
        return places


def _summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, place, np.concatenate(times))
    return distinct, total


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run meanwhile hand rows to Python in batches of about ``BATCH_BYTES``."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def encode(docs: DataFrame, *keys: str, width: int = 4) -> DataFrame:
    """The ``keys`` of every row and the ids of both tokenizers, ``a`` and ``b``, as little-endian
    unsigned integers of ``width`` bytes; none for texts whose tokens do not give their bytes back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder()
        for batch in batches:
            for start, stop in slices(batch.column(len(keys))):
                some = batch.slice(start, stop - start)
                texts = some.column(len(keys)).to_pylist()
                made = [[b""] * len(texts), [b""] * len(texts)]
                failed = np.zeros(len(texts), dtype=bool)
                for owners, pieces in parts(texts):
                    at, numbers = np.array(owners, dtype=np.int64), held.numbered(pieces)
                    if held.failed:
                        failed[at[np.isin(numbers, list(held.failed))]] = True
                    for side in (0, 1):
                        ids, sizes = held.ids_of(side, numbers)
                        ends = np.cumsum(np.bincount(at, sizes, minlength=len(texts)).astype(np.int64))
                        flat = ids.astype(f"<u{width}").tobytes()
                        first = 0
                        for i, end in enumerate((width * ends).tolist()):
                            made[side][i] += flat[first:end]
                            first = end
                ids = [
                    pa.array([b"" if no else x for no, x in zip(failed, side, strict=True)], pa.binary())
                    for side in made
                ]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keys)], *ids], names=[*keys, "a", "b"])

    rows = text_rows(docs, *keys)
    return rows.mapInArrow(run, schema_of(rows, keys, a="binary", b="binary"))


@dataclass
class Alignment:
    """The ids of some texts on end, and where both tokenizers end a token together: the places
    after the last first and second id of each group."""

    a: np.ndarray
    b: np.ndarray
    a_stops: np.ndarray
    b_stops: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, sizes: list[np.ndarray]) -> Alignment:
        a_ends, b_ends = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
        ends_here = np.zeros(int(a_ends[-1]) + 1 if len(a) else 1, dtype=np.int8)
        ends_here[a_ends] += 1
        ends_here[b_ends] += 1
        stops = [np.flatnonzero(ends_here[ends] == 2) + 1 for ends in (a_ends, b_ends)]
        return cls(a, b, *stops)

    def pairs(self) -> np.ndarray:
        """The linked ids of each group: the first times 2^32, and the second."""
        return self.a[self.a_stops - 1] << 32 | self.b[self.b_stops - 1]

    def said(self, firsts: np.ndarray, names: list[str]) -> list[str]:
        """The names of all ids in order of the groups, first ids before second ones, with what
        stands before each. ``firsts`` are the groups that begin a text."""
        n_a, n_b, kinds = len(self.a), len(self.b), len(names) // 4
        a_starts = np.concatenate([[0], self.a_stops])[:-1]
        b_starts = np.concatenate([[0], self.b_stops])[:-1]
        group_of_a = np.repeat(np.arange(len(a_starts)), self.a_stops - a_starts)
        group_of_b = np.repeat(np.arange(len(b_starts)), self.b_stops - b_starts)
        a_kind, b_kind = np.full(n_a, 1), np.full(n_b, 1)
        a_kind[a_starts], b_kind[b_starts] = 2, 3
        a_kind[a_starts[firsts]] = 0
        codes = np.empty(n_a + n_b, dtype=np.int64)
        codes[np.arange(n_a) + b_starts[group_of_a]] = a_kind * kinds + self.a
        codes[np.arange(n_b) + self.a_stops[group_of_b]] = b_kind * kinds + self.b
        return list(map(names.__getitem__, codes.tolist()))


def _names(tokens: Tokens) -> list[str]:
    """Decimal ids: at a text's begin, after a comma, after a semicolon, after a bar."""
    ids = range(max(len(tokens.a_bytes), len(tokens.b_bytes)))
    return [f"{sign}{i}" for sign in ("", ",", ";", "|") for i in ids]


def _aligned(
    batches: Iterable[pa.RecordBatch], sizes: list[np.ndarray], width: int
) -> Iterator[tuple[pa.RecordBatch, Alignment, list[np.ndarray]]]:
    """Rows whose last two columns are ids of ``width`` bytes, some at a time, with their alignment and
    how many ids of each kind each row has."""
    for batch in batches:
        for start, stop in slices(batch.column(batch.num_columns - 1), SLICE_BYTES * width // 4):
            some = batch.slice(start, stop - start)
            held = [some.column(some.num_columns - 2 + side).to_pylist() for side in (0, 1)]
            a, b = (np.frombuffer(b"".join(cells), f"<u{width}").astype(np.int64) for cells in held)
            yield some, Alignment.of(a, b, sizes), [np.array([len(x) // width for x in c]) for c in held]


def pair_counts(encoded: DataFrame, width: int = 4) -> DataFrame:
    """``pair`` and ``n``: each task's distinct pairs with how many links of its documents hold them."""
    known = Tokens().sizes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []
        times: list[np.ndarray] = []
        for _, aligned, _ in _aligned(batches, known, width):
            distinct, often = np.unique(aligned.pairs(), return_counts=True)
            pairs.append(distinct)
            times.append(often)
            if sum(map(len, pairs)) > HELD_PAIRS:
                one = _summed(pairs, times)
                pairs, times = [one[0]], [one[1]]
        distinct, total = _summed(pairs, times)
        for i in range(0, len(distinct), 100_000):
            columns = [pa.array(x[i : i + 100_000]) for x in (distinct, total)]
            yield pa.RecordBatch.from_arrays(columns, names=["pair", "n"])

    return encoded.select("a", "b").mapInArrow(run, "pair bigint, n bigint")


def _vectors(counts: DataFrame, hashed: PairHash) -> DataFrame:
    """Each task's counts as a vector at the places of the hash, in cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(len(hashed.keys), dtype=np.int64)
        for batch in batches:
            places = hashed.find(batch.column(0).to_numpy())
            if (places < 0).any():
                raise ValueError("a pair is not among the distinct pairs")
            np.add.at(vector, places, batch.column(1).to_numpy())
        group = TaskContext.get().partitionId() % FAN
        for cell in range(-(-len(vector) // CELL)):
            some = vector[cell * CELL : (cell + 1) * CELL]
            if some.any():
                columns = [pa.array([cell]), pa.array([group]), pa.array([some.tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "branch", "counts"])

    return counts.mapInArrow(run, "cell bigint, branch bigint, counts binary")


def _sum_cells(vectors: DataFrame) -> DataFrame:
    """The sum of all vectors of a cell and branch, which pass by one at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None

        def made() -> pa.RecordBatch:
            columns = [pa.array([x]) for x in (*last, total.tobytes())]
            return pa.RecordBatch.from_arrays(columns, names=["cell", "branch", "counts"])

        for batch in batches:
            for i in range(batch.num_rows):
                cell, branch, counts = (column[i].as_py() for column in batch.columns)
                vector = np.frombuffer(counts, np.int64)
                if (cell, branch) == last:
                    total = total + vector
                else:
                    if last is not None:
                        yield made()
                    last, total = (cell, branch), vector
        if last is not None:
            yield made()

    laid = vectors.repartition("cell", "branch").sortWithinPartitions("cell", "branch")
    return laid.mapInArrow(run, "cell bigint, branch bigint, counts binary")


@dataclass
class Counts:
    """The corpus-wide count of every linked pair, and whether it is the highest of its second id."""

    hashed: PairHash
    counts: np.ndarray
    best: np.ndarray

    @classmethod
    def of(cls, counted: DataFrame) -> Counts:
        """From a table of pairs and counts. Distinct pairs and the vector of their counts come
        to the driver: they are bounded by the vocabularies, which is checked."""
        bound = Tokens().pair_bound()
        found = counted.select("pair").distinct().limit(bound + 1).toArrow().column(0)
        if len(found) > bound:
            raise ValueError(f"more than {bound} linked pairs")
        hashed = PairHash.of(found.to_numpy())
        branches = _sum_cells(_vectors(counted, hashed))
        whole = _sum_cells(branches.withColumn("branch", F.lit(0).cast("bigint")))
        counts = np.zeros(len(hashed.keys), dtype=np.int64)
        for row in whole.select("cell", "counts").collect():
            some = np.frombuffer(row["counts"], np.int64)
            counts[row["cell"] * CELL : row["cell"] * CELL + len(some)] = some
        second = hashed.keys & 0xFFFFFFFF
        highest = np.zeros(int(second.max(initial=0)) + 1, dtype=np.int64)
        np.maximum.at(highest, second, counts)
        return cls(hashed, counts, counts == highest[second])

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each pair, and whether it is the highest of its second id; 0 and no for
        pairs that were never linked."""
        places = self.hashed.find(pairs)
        known = places >= 0
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        counts[known], best[known] = self.counts[places[known]], self.best[places[known]]
        return counts, best


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of ``sizes`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]



def alignments(encoded: DataFrame, counts: Counts, *keys: str, width: int = 4) -> DataFrame:
    """The ``keys`` of every row of ``encode`` with its alignment: tokens of both, groups, links, those
    that are the best of their second id, the sum of their counts, and ``groups``, as text: first
    ids, a bar, second ids, and a semicolon between groups."""
    known = Tokens().sizes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(encoder().tokens)
        for some, aligned, (n_a, n_b) in _aligned(batches, known, width):
            a_ends, ends = np.cumsum(n_a), np.cumsum(n_a + n_b)
            groups = np.searchsorted(aligned.a_stops, a_ends, side="right")
            n_groups = np.diff(groups, prepend=0)
            times, best = counts.look_up(aligned.pairs())
            columns = [n_a, n_b, n_groups, n_groups, _sums(best.astype(np.int64), n_groups)]
            columns.append(_sums(times, n_groups))
            said = aligned.said((groups - n_groups)[n_groups > 0], names)
            texts = ["".join(said[i:j]) for i, j in zip((ends - n_a - n_b).tolist(), ends.tolist(), strict=True)]
            made = [*map(pa.array, columns), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*some.columns[: len(keys)], *made], names=[*keys, *_MADE, "groups"]
            )

    rows = encoded.select(*keys, "a", "b")
    kinds = dict.fromkeys(_MADE, "long") | {"groups": "string"}
    return rows.mapInArrow(run, schema_of(rows, keys, **kinds))


def align(docs: DataFrame) -> DataFrame:
    """Every document's alignment with counts over all documents.

    ``doc_id``; ``n_a`` and ``n_b``, tokens of each tokenizer for a space and the text; ``n_groups``;
    ``n_links``, the pairs of tokens that end together; ``n_best``, those whose count is the
    highest of their second id (ties included); ``count_sum``, the sum of their counts, a count
    being the links of all documents with the same two ids; ``groups_sha256`` of the groups in order.
    Null and empty texts, and those whose tokens do not give their bytes back, have no tokens: zeros
    and an empty digest. Repeated rows count and appear each time, null ids too; no rows give
    none. Other columns are not read.
    """
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    width = Tokens().width()
    with small_batches(docs.sparkSession):
        encoded = store(encode(own, "doc_id", width=width), "both-ids")
        counted = store(pair_counts(encoded, width), "pair-counts")
        made = alignments(encoded, Counts.of(counted), "doc_id", width=width)
        return store(made.select("doc_id", *_MADE, digest.alias("groups_sha256")), "alignments")
