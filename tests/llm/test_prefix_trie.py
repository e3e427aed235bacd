"""Prefix tries against a plain one, over shards of any size."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from tillwise.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path int, position string"


def plain_conversations(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [row[2:] for row in sorted(said)] for c, said in own.items()}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + said[h:]
    return built


def plain_trie(built):
    members = defaultdict(list)
    for c, said in built.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in below]
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(path))
        out.append(
            (
                min(who),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(who),
                sum(len(p) == len(path) + 1 for p in below),
                sum(not any(q[:-1] == p for q in members if q) for p in below),
                sum((len(members[p]) - 1) * n for p, n in zip(below, words, strict=True)),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=lambda row: row[:2])


def some_rows(seed, conversations=90):
    pick = random.Random(seed)
    texts = [None, "", " ", "yes", "no no", "a\tb  c\n", "É é x", "日本 語"]
    rows = []
    for c in pick.sample(range(conversations * 2), conversations):
        for turn in range(pick.choice([1, 1, 2, 3, 4, 6])):
            at = pick.choice([turn, turn, None])
            rows.append((c, at, pick.choice(["user", "assistant", None]), pick.choice(texts[:4]), 1, "x"))
    rows += [(c, turn, "user", "same", 1, "x") for c in range(1000, 1040) for turn in range(5)]
    rows += rows[3:9]
    rows += [(7000, turn, "user", pick.choice(texts), 1, "x") for turn in range(300)]
    rows += [(None, 0, "user", "nobody's", 1, "x")]
    return rows


def whole(spark, rows):
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA))
    return [tuple(row) for row in prefix_trie.trie(prefix_trie.rebuilt(turns)).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    rows = some_rows(seed)
    assert sorted(whole(spark, rows), key=lambda r: r[:2]) == plain_trie(plain_conversations(rows))


def test_empty(spark):
    assert whole(spark, []) == []
    assert whole(spark, [(None, 1, "user", "a", 1, "x")]) == []


def test_without_turns_left(spark):
    """Conversation 22 takes one turn over from one that is not there, and has no other."""
    assert zlib.crc32(b"22") % 4 > 0
    nothing = hashlib.sha256(b"22").hexdigest()
    assert whole(spark, [(22, 0, "user", "a", 1, "x")]) == [(22, 0, None, 1, 0, 1, 0, nothing)]


def test_shards(monkeypatch):
    """Shards end between conversations, and their nodes hold all members between them."""
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", 3)
    rows = [(c, p, None if p < 0 else b"%d" % (c % 2 if p else 0), p + 1) for c in range(10) for p in range(-1, 2)]
    columns = [pa.array(column) for column in zip(*rows, strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["conv_id", "position", "turn", "words"])
    shards = list(prefix_trie._shards([batch.slice(0, 7), batch.slice(7, 1), batch.slice(8)]))
    assert [shard.ids for shard in shards] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]]
    nodes = [node for shard in shards for node in shard.nodes()]
    assert sum(node[3].bit_count() for node in nodes) == 30
    assert {depth for _, _, depth, *_ in nodes} == {0, 1, 2}
