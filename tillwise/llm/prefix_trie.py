"""A trie of conversations by their first turns, from vertical bitmaps.

Conversations are cut into shards by their id. A shard indexes (position, turn) to the bitset of its
conversations that have this turn there; from the root, whose bitset is all of them, a search
in depth intersects a node's bitset with the postings of the next position. Each intersection
that is not empty is a child: its popcount is the members, and what ends there is one more
intersection. Nodes of all shards that stand for the same turns are summed up.

What a node says of its whole subtree adds up over shards too, once it is known at which depth each
conversation becomes the smallest member of its nodes: such nodes are counted with that
conversation, in whose shard it is alone. So a second search, over the same shards' rows, sums
leaves and savings from the bottom up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, groupby
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import store

# Conversations, and turns, after which a shard is closed.
SHARD_CONVERSATIONS = 4096
SHARD_TURNS = 200_000
ROOT = bytes(16)
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 20_000


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``position`` from 0, ``turn`` (a 128-bit hash of role and text) and ``words``.

    Turns go by ``turn`` (null first), equal ones by role and text; repeated rows are turns as
    well. Null roles and texts are empty; rows without a ``conv_id`` belong to no conversation.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint").alias("at"), role, text
    ).where(F.col("conv_id").isNotNull())
    order = Window.partitionBy("conv_id").orderBy("at", "role", "text")
    said = F.concat(F.length("role").cast("string"), F.lit(" "), F.col("role"), F.col("text"))
    return rows.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("position"),
        F.unhex(F.md5(said)).alias("turn"),
        F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"),
    )


def shared_start(conv_id: Column) -> Column:
    """How many first turns a rebuilt conversation takes over."""
    return (F.crc32(conv_id.cast("string")) % 4).cast("bigint")


def rebuilt(turns: DataFrame, block: int = 20) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their block.

    The first h turns of conversation c - c % ``block`` (all if it has fewer, none if there is
    none), then c's own turns after its first h; h is ``shared_start``, 0 to 3. Each
    conversation also has a row at position -1, so that those left without a turn are seen.
    """
    turns = store(turns, "turns")
    starts = turns.where((F.col("position") < 3) & (F.col("conv_id") % block == 0))
    starts = starts.groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("position", "turn", "words"))).alias("start")
    )
    ids = turns.where("position = 0").select("conv_id")
    ids = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    h = shared_start(F.col("conv_id"))
    taken = F.coalesce(F.slice("start", F.lit(1), h.cast("int")), F.array())
    begun = ids.join(starts, "base", "left").select("conv_id", taken.alias("taken"))
    mark = F.struct(
        F.lit(-1).cast("bigint").alias("position"),
        F.lit(None).cast("binary").alias("turn"),
        F.lit(0).cast("bigint").alias("words"),
    )
    first = begun.select("conv_id", F.inline(F.concat(F.array(mark), "taken")))
    # A conversation's own turns move up if the first one of its block has fewer than h.
    short = begun.select("conv_id", (h - F.size("taken")).alias("missing")).where("missing > 0")
    later = turns.where(F.col("position") >= h).join(short, "conv_id", "left")
    place = F.col("position") - F.coalesce("missing", F.lit(0))
    return first.union(later.select("conv_id", place.cast("bigint"), "turn", "words"))


@dataclass
class Shard:
    """Some conversations, numbered in order of their ids, and the index of their turns."""

    ids: list[int] = field(default_factory=list)
    turns: list[list[bytes]] = field(default_factory=list)
    words: list[list[int]] = field(default_factory=list)
    opens: list[tuple[int, bool]] = field(default_factory=list)
    size: int = 0

    def add(self, conv_id: int, rows: Iterable[tuple]) -> None:
        """A conversation's rows: turn, words, and where known from which depth on it is the
        smallest member and whether it is that of a leaf."""
        turns, words, opens = [], [], (None, False)
        for position, turn, n, *more in rows:
            if more:
                opens = tuple(more)
            if position >= 0:
                turns.append(turn)
                words.append(n)
        self.ids.append(conv_id)
        self.turns.append(turns)
        self.words.append(words)
        self.opens.append(opens)
        self.size += 1 + len(turns)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_CONVERSATIONS or self.size >= SHARD_TURNS

    def index(self) -> tuple[list[dict[bytes, int]], dict[int, int]]:
        """For each position the bitset of every turn there, and for each length that of the
        conversations which end after so many turns."""
        postings: list[dict[bytes, int]] = [{} for _ in range(max(map(len, self.turns), default=0))]
        ends: dict[int, int] = {}
        for i, turns in enumerate(self.turns):
            bit = 1 << i
            ends[len(turns)] = ends.get(len(turns), 0) | bit
            for posting, turn in zip(postings, turns, strict=False):
                posting[turn] = posting.get(turn, 0) | bit
        return postings, ends

    def members(self, bits: int) -> list[int]:
        """The ids of a bitset, ascending."""
        found = []
        while bits:
            low = bits & -bits
            found.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return found

    def nodes(self) -> Iterator[tuple[bytes, bytes, int, int, int, int, int]]:
        """Every node, a parent before its children: path, parent's path, depth, bitset, that of
        those who end there, words of the last turn, and the place of its parent among all."""
        postings, ends = self.index()
        number = 0
        waiting = [(ROOT, ROOT, 0, (1 << len(self.ids)) - 1, 0, -1)]
        while waiting:
            path, parent, depth, bits, words, above = waiting.pop()
            over = bits & ends.get(depth, 0)
            yield path, parent, depth, bits, over, words, above
            rest = bits ^ over
            while rest:
                one = (rest & -rest).bit_length() - 1
                turn = self.turns[one][depth]
                child = rest & postings[depth][turn]
                rest ^= child
                below = hashlib.md5(path + turn, usedforsecurity=False).digest()
                waiting.append((below, path, depth + 1, child, self.words[one][depth], number))
            number += 1


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[Shard]:
    """Rows in order of conversation and position, cut into shards between conversations."""
    rows = (
        row
        for batch in batches
        for row in zip(*[column.to_pylist() for column in batch.columns], strict=True)
    )
    shard = Shard()
    for conv_id, group in groupby(rows, key=lambda row: row[0]):
        shard.add(conv_id, (row[1:] for row in group))
        if shard.full():
            yield shard
            shard = Shard()
    if shard.ids:
        yield shard


def _batches(rows: Iterable[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(zip(*held, strict=True), kinds.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=list(kinds))

    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


_LONG, _BYTES = pa.int64(), pa.binary()
_NODES = {
    "path": _BYTES, "parent": _BYTES, "depth": _LONG, "conv_id": _LONG, "n_convs": _LONG,
    "first_end": _LONG, "ends": pa.string(),
}
_SUMS = {"path": _BYTES, "n_leaves": _LONG, "saved_tokens": _LONG}
_ENDS = {"path": _BYTES, "ends_sha256": pa.string()}


def _laid(rows: DataFrame) -> DataFrame:
    """Ranges of conversations, so that the shards' end lists follow one another."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id", "position")


def _shard_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of each shard: smallest member, members, and the ids that end there, with the
    first of these."""

    def of(shard: Shard) -> Iterator[tuple]:
        for path, parent, depth, bits, over, _, _ in shard.nodes():
            least = shard.ids[(bits & -bits).bit_length() - 1]
            ends = shard.members(over)
            listed = ",".join(map(str, ends)) if ends else None
            yield path, parent, depth, least, bits.bit_count(), ends[0] if ends else None, listed

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((row for shard in _shards(batches) for row in of(shard)), _NODES)

    schema = "path binary, parent binary, depth long, conv_id long, n_convs long, first_end long, ends string"
    laid = _laid(rows.select("conv_id", "position", "turn", "words"))
    return laid.mapInArrow(run, schema)


def _subtree_sums(rows: DataFrame) -> DataFrame:
    """``n_leaves`` and ``saved_tokens`` of each shard's nodes, with their subtrees there."""

    def of(shard: Shard) -> Iterator[tuple]:
        leaves = sum(1 << i for i, (_, leaf) in enumerate(shard.opens) if leaf)
        opened = [0] * (1 + max(map(len, shard.turns), default=0))
        for i, (depth, _) in enumerate(shard.opens):
            if depth is not None:
                opened[depth] |= 1 << i
        # At each depth, who is the smallest member of a node there.
        least = list(accumulate(opened, or_))
        paths, found, saved, above = [], [], [], []
        for path, _, depth, bits, _, words, parent in shard.nodes():
            paths.append(path)
            found.append((bits & leaves).bit_count())
            saved.append(words * (bits & ~least[depth]).bit_count())
            above.append(parent)
        for i in range(len(paths) - 1, 0, -1):
            saved[above[i]] += saved[i]
        yield from zip(paths, found, saved, strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((row for shard in _shards(batches) for row in of(shard)), _SUMS)

    return _laid(rows).mapInArrow(run, "path binary, n_leaves long, saved_tokens long")


def _end_digests(nodes: DataFrame) -> DataFrame:
    """SHA-256 of each node's end list: the lists of its shards pass by in order, one at a time."""

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (
            row
            for batch in batches
            for row in zip(*[batch.column(i).to_pylist() for i in (0, 2)], strict=True)
        )
        for path, group in groupby(rows, key=lambda row: row[0]):
            digest, between = hashlib.sha256(), b""
            for _, ends in group:
                digest.update(between + ends.encode())
                between = b","
            yield path, digest.hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(digests(batches), _ENDS)

    rows = nodes.where("ends is not null").select("path", "first_end", "ends")
    in_order = rows.repartition("path").sortWithinPartitions("path", "first_end")
    return in_order.mapInArrow(run, "path binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of all conversations' first turns, one row each.

    ``rows`` has ``conv_id``, ``position``, ``turn`` and ``words``, and for every conversation a row at
    position -1, as ``rebuilt`` gives them. A node is the conversations that begin with the same
    turns: ``conv_id`` is its smallest member, ``depth`` its number of turns, from the root at 0,
    ``parent_conv_id`` the smallest member of the node one turn shorter (null for the root).
    ``n_convs`` members, ``n_children`` children, ``n_leaves`` childless nodes in its subtree,
    itself included; ``saved_tokens``, summed over the subtree, the words of each node's last turn
    times its members but one; ``ends_sha256``, the digest of the ids of those who have no more
    turns, ascending, joined by commas. No conversations, no rows.

    Turns and paths are told apart by 128-bit hashes. A node that very many share is one row for
    each shard before it is summed up.
    """
    rows = store(rows, "trie-rows")
    local = store(_shard_nodes(rows), "trie-shards")
    nodes = local.groupBy("path").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
    )
    children = local.where("depth > 0").select("path", "parent").distinct()
    children = children.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "path", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))
    )
    nodes = store(nodes, "trie-nodes")
    opens = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("opens"), F.max(F.col("n_children") == 0).alias("leaf")
    )
    sums = _subtree_sums(rows.join(opens, "conv_id", "left").select(*rows.columns, "opens", "leaf"))
    sums = sums.groupBy("path").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    above = nodes.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("depth > 0").join(above, "parent", "left")
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    whole = below.unionByName(top).join(sums, "path").join(_end_digests(local), "path", "left")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
