"""Near duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into four segments of 16. The binary Golay code of length 23 is
perfect: every word lies within 3 bits of exactly one of its 4,096 codewords. A segment, with seven
zeros ahead, decodes to the index of that codeword, and its neighbours at one bit decode to the
indices nearby; so segments that differ in one bit at most share an index.

If two fingerprints differ in ``DIFFERING`` = 3 bits at most, some segment is equal in both and
the one after it, in a circle, differs in one bit at most: of two or more equal segments, no two
are followed by the same one, and with a single equal segment all others differ in one bit.
So an equal segment and an index of the next make a key that such a pair is sure to share.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .stored import store
from .texts import schema_of, slices, text_rows

SHINGLE = 3
SEED = 42
DIFFERING = 3
SEGMENTS = 4
SEGMENT_BITS = 16
# Bytes of a text whose words are held at a time, and fingerprints of a bucket that are compared
# with others at a time.
PIECE = 1 << 20
BLOCK = 4096
# A bucket of more fingerprints is cut again by the index of another segment.
LARGE = 4096
FAN = 256

# Fixed value: the generator polynomial of the Golay code of length 23.
GENERATOR = 0b101011100011
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _remainders(words: np.ndarray) -> np.ndarray:
    """What is left of each 23-bit polynomial after division by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _error_patterns() -> np.ndarray:
    """For each of the 2,048 remainders, the one pattern of up to three errors that leaves it."""
    bits = 1 << np.arange(23, dtype=np.int64)
    one = np.concatenate([[0], bits])
    up_to_three = np.unique((one[:, None, None] | one[:, None] | one).ravel())
    patterns = np.zeros(1 << 11, dtype=np.int64)
    patterns[_remainders(up_to_three)] = up_to_three
    return patterns


def decode(words: np.ndarray) -> np.ndarray:
    """The index, 0 to 4,095, of the codeword within three bits of each 23-bit word."""
    return (words ^ _error_patterns()[_remainders(words)]) >> 11


def _index_table() -> np.ndarray:
    """For each segment, the indices of itself and of its neighbours at one bit, each once: its own
    first, the others ascending, -1 for none."""
    own = decode(np.arange(1 << SEGMENT_BITS, dtype=np.int64))
    flips = np.arange(1 << SEGMENT_BITS)[:, None] ^ (1 << np.arange(SEGMENT_BITS))
    near = np.sort(own[flips], axis=1)
    again = near == own[:, None]
    again[:, 1:] |= near[:, 1:] == near[:, :-1]
    near = np.sort(np.where(again, 1 << 12, near), axis=1)
    widest = int((near < 1 << 12).sum(axis=1).max())
    near = near[:, :widest]
    return np.concatenate([own[:, None], np.where(near < 1 << 12, near, -1)], axis=1)


_tables: list[np.ndarray] = []


def indices() -> np.ndarray:
    """The table of all segments, made once in each worker."""
    if not _tables:
        _tables.append(_index_table())
    return _tables[0]


def _hashes(data: bytes) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text's bytes, repeats included, piece by piece."""
    at, before, any_yet = 0, [], False
    while at < len(data):
        end = _SPACE.search(data, at + PIECE)
        stop = end.start() if end else len(data)
        words = before + data[at:stop].lower().split()
        runs = zip(*[words[i:] for i in range(SHINGLE)], strict=False)
        found = [xxhash.xxh64_intdigest(b" ".join(run), SEED) for run in runs]
        if found:
            any_yet = True
            yield np.array(found, dtype=np.uint64)
        before, at = words[-SHINGLE + 1 :], stop
    if before and not any_yet:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(before), SEED)], dtype=np.uint64)


def fingerprint(text: str) -> int:
    """Bit by bit, what over half of the text's shingles have; 0 for a text without words."""
    votes, n = np.zeros(64, dtype=np.int64), 0
    for hashes in _hashes(text.encode()):
        for i in range(0, len(hashes), 1 << 14):
            some = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """The ``keys`` and ``fingerprint``, as a signed long, of every row. Null texts count as empty."""
    rows = text_rows(docs, *keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(len(keys))):
                some = batch.slice(start, stop - start)
                made = [fingerprint(text) for text in some.column(len(keys)).to_pylist()]
                signed = np.array(made, dtype=np.uint64).view(np.int64)
                columns = [*some.columns[: len(keys)], pa.array(signed)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "fingerprint"])

    return rows.mapInArrow(run, schema_of(rows, keys, fingerprint="long"))


def segments_of(fingerprints: np.ndarray) -> np.ndarray:
    """The four segments of each fingerprint, low bits first."""
    shifts = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(SEGMENT_BITS)
    parts = fingerprints.view(np.uint64)[:, None] >> shifts
    return (parts & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64)


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of fingerprints: the key, the place of its fingerprint, and whether the index in
    it is the segment's own."""
    parts, table = segments_of(fingerprints), indices()
    out = []
    for first in range(SEGMENTS):
        near = table[parts[:, (first + 1) % SEGMENTS]]
        place, column = np.nonzero(near >= 0)
        key = (first << 28) | (parts[place, first] << 12) | near[place, column]
        out.append((key, place, column == 0))
    key, place, own = (np.concatenate(columns) for columns in zip(*out, strict=True))
    return key, place, own


def keys_again(
    keys: np.ndarray, fingerprints: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longer keys of rows that have one: a pair under a key differs in three bits at most in
    the two segments that are not in it, so in one of them in one bit at most."""
    parts, table, out = segments_of(fingerprints), indices(), []
    first = keys >> 28
    for step in (2, 3):
        near = table[parts[np.arange(len(keys)), (first + step) % SEGMENTS]]
        place, column = np.nonzero(near >= 0)
        key = (np.int64(step) << 48) | (keys[place] << 12) | near[place, column]
        out.append((key, place, column == 0))
    key, place, own = (np.concatenate(columns) for columns in zip(*out, strict=True))
    return key, place, own


_KEYED = "key bigint, fingerprint bigint, own boolean"


def _keyed(key: np.ndarray, fingerprint: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(key), 100_000):
        columns = [pa.array(x[i : i + 100_000]) for x in (key, fingerprint, own)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "fingerprint", "own"])


def _first_keys(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_numpy()
            key, place, own = keys_of(held)
            yield from _keyed(key, held[place], own)

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A fingerprint makes some twenty rows, so the table is dealt to as many tasks as a shuffle has.
    return distinct.select("fingerprint").repartition(parts, "fingerprint").mapInArrow(run, _KEYED)


def _longer_keys(keyed: DataFrame) -> DataFrame:
    """Of rows under large keys; only an own row counts as own again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            was_own = batch.column(2).to_numpy(zero_copy_only=False)
            key, place, own = keys_again(keys, held)
            yield from _keyed(key, held[place], own & was_own[place])

    return keyed.select("key", "fingerprint", "own").mapInArrow(run, _KEYED)


def near_to(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each of ``others``, the place of one of ``one`` within ``DIFFERING`` bits, or -1."""
    found = np.full(len(others), -1, dtype=np.int64)
    step = max(1, (1 << 22) // max(1, len(others)))
    for i in range(0, len(one), step):
        close = np.bitwise_count(one[i : i + step, None] ^ others) <= DIFFERING
        hit = close.any(axis=0)
        found[hit & (found < 0)] = i + close[:, hit & (found < 0)].argmax(axis=0)
        if (found >= 0).all():
            break
    return found


def linked(values: np.ndarray) -> np.ndarray:
    """A number for each distinct fingerprint, equal if and only if they are connected by steps of at
    most ``DIFFERING`` bits among them.

    A search in breadth from one to the next: what it has come to is compared with what it has
    not, so a family around one member takes a few passes, not all its pairs.
    """
    group = np.full(len(values), -1, dtype=np.int64)
    left = np.arange(len(values))
    number = 0
    while len(left):
        # The one that agrees bit by bit with most is likely to be amid the others.
        bits = (values[left, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        middle = (2 * bits.sum(axis=0) > len(left)).astype(np.uint64) << np.arange(64, dtype=np.uint64)
        centre = np.bitwise_or.reduce(middle)
        start = int(np.bitwise_count(values[left] ^ centre).argmin())
        reached, left = left[start : start + 1], np.delete(left, start)
        group[reached] = number
        while len(reached) and len(left):
            hit = near_to(values[reached[:BLOCK]], values[left]) >= 0
            group[left[hit]] = number
            reached = np.concatenate([reached[BLOCK:], left[hit]])
            left = left[~hit]
        number += 1
    return group


def tree_links(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect each group: every member to one before it, ``FAN`` to each, so that no
    member gets many."""
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    first = np.searchsorted(group, group, side="left")
    place = np.arange(len(group)) - first
    before = first + (np.maximum(place, 1) - 1) // FAN
    later = place > 0
    return values[before[later]], values[later]


def _links(laid: DataFrame) -> DataFrame:
    """The links of each key's fingerprints; rows of a key lie together, ascending."""

    def of_bucket(held: list[np.ndarray]) -> pa.RecordBatch | None:
        values = np.unique(np.concatenate(held).view(np.uint64))
        if len(values) < 2:
            return None
        a, b = tree_links(values, linked(values))
        sides = [pa.array(side.view(np.int64)) for side in (a, b)]
        return pa.RecordBatch.from_arrays(sides, names=["a", "b"]) if len(a) else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts = [0, *cuts.tolist(), len(keys)]
            for start, stop in zip(starts[:-1], starts[1:], strict=True):
                if keys[start] != last and held:
                    if (made := of_bucket(held)) is not None:
                        yield made
                    held = []
                last = keys[start]
                held.append(values[start:stop])
        if held and (made := of_bucket(held)) is not None:
            yield made

    in_order = laid.select("key", "fingerprint").repartition("key")
    return in_order.sortWithinPartitions("key", "fingerprint").mapInArrow(run, "a bigint, b bigint")


def _buckets(keyed: DataFrame) -> DataFrame:
    """``key`` and ``size`` of the keys under which a pair can meet: one side's index is its own."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.max("own").alias("own"))
    return sizes.where("size > 1 and own").select("key", "size")


def links(distinct: DataFrame) -> DataFrame:
    """``a`` and ``b``: links that connect exactly those of the distinct fingerprints that steps
    of at most ``DIFFERING`` bits connect."""
    keyed = _first_keys(distinct)
    buckets = store(_buckets(keyed), "simhash-buckets")
    small = keyed.join(buckets.where(F.col("size") <= LARGE), "key", "left_semi")
    found = _links(small)
    large = buckets.where(F.col("size") > LARGE)
    if not large.isEmpty():
        again = _longer_keys(keyed.join(large.select("key"), "key"))
        found = found.union(_links(again.join(_buckets(again).select("key"), "key", "left_semi")))
    return store(found, "simhash-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of every document.

    Words are what stands between spaces and the controls from tab to carriage return; A-Z count
    as a-z. A bit of the fingerprint is 1 if it is set in over half of the XXH64 (seed 42) of the
    text's runs of three words, repeats included; a text of fewer words has one run, and a text
    without words, or a null one, the fingerprint 0, which links as any other. Fingerprints that
    differ in three bits or fewer are linked; ``component_id`` is the smallest id reachable. A
    null id is never a ``component_id``, but where no other id can be reached. Each row has a row
    in the result, repeated ones too; no rows give none. Other columns are not read.

    Texts of one fingerprint are one node, whatever their number. Keys that more than ``LARGE``
    nodes share are cut again; within a key, links form a tree, so there are fewer than nodes.
    """
    own = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"])
    each = store(fingerprints(own, "doc_id"), "simhash")
    distinct = each.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    distinct = store(distinct, "simhash-distinct")
    roots = components(links(distinct)).withColumnRenamed("node", "fingerprint")
    rooted = distinct.join(roots, "fingerprint", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return each.join(named, "fingerprint", "left").select(
        "doc_id", digits.alias("fingerprint"), "component_id"
    )
