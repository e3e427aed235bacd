"""Byte-level BPE: encoding in padded matrices, and decoding.

Texts are cut at the tokenizer's pattern; distinct pieces are encoded once per worker. The
pieces of about one length are the rows of a padded matrix, and in each round every row
merges its leftmost pair of minimum rank, until no row has a pair left.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .texts import schema_of, slices, text_rows
from .tokenizer_files import PATTERN, vocabulary

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NO_RANK = np.int32(2**31 - 1)
# Pieces of more bytes are merged one by one with a heap, as a matrix of them is mostly moved.
LONGEST_ROW = 256
CACHED_CHUNKS = 250_000
PUNCTUATION = ".,;:!?\"#$%&()*+-/<=>@[]^_`{|}~"
# The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


class PairTable:
    """Hashed lookup of the token that two adjacent tokens make."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.made = np.full(1 << bits, NO_RANK, dtype=np.int32)
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        made = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        slots, self.probes = self._slots(keys), 0
        while len(keys):
            free = self.keys[slots] < 0
            _, first = np.unique(slots, return_index=True)
            chosen = np.zeros(len(keys), dtype=bool)
            chosen[first] = True
            chosen &= free
            self.keys[slots[chosen]], self.made[slots[chosen]] = keys[chosen], made[chosen]
            keys, made, slots = keys[~chosen], made[~chosen], slots[~chosen] + 1
            slots &= len(self.keys) - 1
            self.probes += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens; ``NO_RANK`` where there is none or a token is -1."""
        keys = (left.astype(np.int64) << 32 | right).ravel()
        keys[(left < 0).ravel() | (right < 0).ravel()] = -2
        slots = self._slots(keys)
        found = self.keys[slots]
        made = np.where(found == keys, self.made[slots], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            made[open_[hit]] = self.made[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return made.reshape(left.shape)


class ByteBpe:
    """Encoder and decoder for the ranks of one vocabulary file."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            parts = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in parts}
        self.pair = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # The pattern means the Unicode property, whatever a library takes for white space.
        spaced = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]")
        self.pieces = regex.compile(spaced.replace(r"\S", f"[^{WHITE}]")).findall
        self.spaced = [white + " " for white in WHITE]
        self.chunks = regex.compile(
            f"[ ]?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
        ).findall
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(token) for token in tokens], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The token ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._cut(text) for text in texts]
        if len(self.cache) > CACHED_CHUNKS:
            self.cache.clear()
        new = [chunk for chunk in set().union(*cut) if chunk not in self.cache]
        if new:
            self._learn(new)
        return [b"".join(map(self.cache.__getitem__, chunks)) for chunks in cut]

    def _cut(self, text: str) -> list[str]:
        """Chunks at whose bounds the pattern always cuts: runs without white space, each
        with the one space before it, and what other white space there is."""
        if any(map(text.__contains__, self.spaced)):
            return self.chunks(text)
        # Every space follows something else here, so a cut before it parts no match.
        chunks = (" " + text).replace(" ", "\0 ").split("\0") if "\0" not in text else None
        if chunks is None:
            return self.chunks(text)
        return [text.partition(" ")[0], *chunks[2:]]

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks by way of their distinct pieces."""
        cut = [self._pieces(chunk) for chunk in chunks]
        pieces = list(set().union(*cut))
        ids = dict(zip(pieces, self._encode_pieces([p.encode() for p in pieces]), strict=True))
        get = ids.__getitem__
        for chunk, parts in zip(chunks, cut, strict=True):
            self.cache[chunk] = get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts))

    def _pieces(self, chunk: str) -> list[str]:
        """The pattern's matches; the common forms, a word with or without punctuation after
        it, need no search."""
        word = chunk.rstrip(PUNCTUATION)
        if word.removeprefix(" ").isalpha():
            return [word] if len(word) == len(chunk) else [word, chunk[len(word) :]]
        return self.pieces(chunk)

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(piece) for piece in pieces])
        for top in (4, 6, 8, 10, 12, 16, 24, 48, 96, LONGEST_ROW):
            rows = np.flatnonzero((lengths <= top) & (lengths > 0))
            lengths[rows] = 0
            step = max(1, 200_000 // top)
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                for row, ids in zip(some, self._merge([pieces[r] for r in some], top), strict=True):
                    out[row] = ids
        for row in np.flatnonzero(lengths):
            out[row] = self._merge_long(pieces[row])
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        joined = b"".join(piece.ljust(width, b"\0") for piece in pieces)
        tokens = self.byte_ids[np.frombuffer(joined, np.uint8)].reshape(-1, width)
        counts = np.array([len(piece) for piece in pieces])
        tokens[np.arange(width) >= counts[:, None]] = -1
        done = np.full((len(pieces), width), -1, dtype=np.int32)
        alive = np.arange(len(pieces))
        ranks = self.pair(tokens[:, :-1], tokens[:, 1:])
        while len(alive):
            at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(alive), np.int64)
            row = np.arange(len(alive))
            best = ranks[row, at]
            ended = best == NO_RANK
            if ended.any():
                done[alive[ended], : tokens.shape[1]] = tokens[ended]
                keep = ~ended
                alive, tokens, ranks = alive[keep], tokens[keep], ranks[keep]
                at, best, row = at[keep], best[keep], np.arange(len(alive))
                if not len(alive):
                    break
            tokens[row, at] = best
            # Compaction: what stands right of the merged pair moves up by one place.
            last = tokens.shape[1] - 1
            place = np.arange(last)
            tokens = np.where(place > at[:, None], tokens[:, 1:], tokens[:, :-1])
            if last == 1:
                done[alive, :1] = tokens
                break
            place = np.arange(last - 1)
            ranks = np.where(place >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            for side in (at - 1, at):
                near = (side >= 0) & (side < last - 1)
                rows, spot = row[near], side[near]
                ranks[rows, spot] = self.pair(tokens[rows, spot], tokens[rows, spot + 1])
        made = done >= 0
        ends = np.cumsum(made.sum(axis=1) * 4).tolist()
        flat = done[made].astype("<u4").tobytes()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, piece: bytes) -> bytes:
        """The same merges with a heap of pairs, for pieces of any length."""
        ids = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        pairs = {}
        array = np.array(ids, dtype=np.int64)
        first = self.pair(array[:-1], array[1:])
        heap = [(int(r), i) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        spans = [piece[i : i + 1] for i in range(n)]
        gone = [False] * n

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                joined = spans[i] + spans[j]
                if joined not in pairs:
                    pairs[joined] = self.ranks.get(joined)
                if pairs[joined] is not None:
                    heapq.heappush(heap, (pairs[joined], i))

        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if not gone[i] else n
            if j >= n or self.ranks.get(spans[i] + spans[j]) != rank:
                continue
            spans[i] += spans[j]
            ids[i], gone[j], after[i] = rank, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([t for t, g in zip(ids, gone, strict=True) if not g], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the token ids stand for."""
        tokens = np.frombuffer(ids, dtype="<u4")
        sizes = self.lengths[tokens]
        total = int(sizes.sum())
        shift = np.repeat(self.begins[tokens] - (np.cumsum(sizes) - sizes), sizes)
        return self.bytes[shift + np.arange(total)].tobytes()


_loaded: dict[str, ByteBpe] = {}


def load(name: str) -> ByteBpe:
    """The tokenizer of a vocabulary, loaded once per worker."""
    if name not in _loaded:
        _loaded[name] = ByteBpe(vocabulary(name))
    return _loaded[name]


def encode(
    docs: DataFrame, *keys: str, vocabulary: str = VOCABULARY, decoded: bool = False
) -> DataFrame:
    """``keys`` of every document with ``n_tokens`` and ``ids``: the token ids of its whole
    text as little-endian unsigned 32-bit integers; with ``decoded``, also the bytes that the ids
    decode to, without sending them through another worker.

    A null or empty text has no tokens. Rows are encoded one by one, so repeated rows and null
    keys come out as they are; columns other than the keys are not read.
    """
    rows = text_rows(docs, *keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts = batch.column(len(keys))
            for start, stop in slices(texts):
                ids = bpe.encode(texts[start:stop].to_pylist())
                part = batch.slice(start, stop - start)
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                columns = [*part.columns[: len(keys)], counts, pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *made])

    made = {"n_tokens": "long", "ids": "binary"} | ({"decoded": "binary"} if decoded else {})
    return rows.mapInArrow(run, schema_of(rows, keys, **made))


def decode(encoded: DataFrame, *keys: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys``, ``n_tokens``, ``ids`` and ``decoded``, the bytes of the text; null ids have none."""
    rows = encoded.select(*keys, "n_tokens", "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            ids = batch.column(len(keys) + 1)
            for start, stop in slices(ids):
                part = batch.slice(start, stop - start)
                made = [bpe.decode(x or b"") for x in ids[start:stop].to_pylist()]
                columns = [*part.columns, pa.array(made, pa.binary())]
                names = [*keys, "n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema_of(rows, rows.columns, decoded="binary"))
