"""Alignments against both libraries over whole texts, and the hash of pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tillwise.llm import alignment
from tillwise.llm.registry import llm_queries

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a\n", "two words", "two  words \n\n  and more\n", "\x00 nul",
    "It's don't we'll 1234 5-6", "日本 語 テスト", "ﬁ ½ Å é́", "<s> </s> <unk> <0x41> <|endoftext|>",
    "a▁b c", "▁", "tab\there \t x", "\x85next　wide   line", "x" * 300,
    "a\x1c b", "emoji 👩‍👩‍👧 done", "same words same words", "same words same words",
]


@pytest.fixture(scope="module")
def tokens():
    return alignment.Tokens()


def plain(tokens, texts):
    """Both libraries on whole texts, offsets as sets."""
    rows, counts = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a = tokens.a.encode(" " + text, add_special_tokens=False).ids
        b = tokens.b.encode(text)
        said = (" " + text).encode()
        if b"".join(tokens.a_bytes[i] for i in a) != said or b"".join(tokens.b_bytes[i] for i in b) != said:
            rows.append(None)
            continue
        ends = []
        for ids, known in ((a, tokens.a_bytes), (b, tokens.b_bytes)):
            at, found = 0, {}
            for i in ids:
                at += len(known[i])
                found[at] = i
            ends.append(found)
        groups, links = [], []
        for end in sorted(set(ends[0]) & set(ends[1])):
            last = groups[-1][0] if groups else 0
            mine = [[str(i) for at, i in found.items() if last < at <= end] for found in ends]
            groups.append((end, ",".join(mine[0]) + "|" + ",".join(mine[1])))
            links.append((ends[0][end], ends[1][end]))
        counts.update(links)
        rows.append((len(a), len(b), groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        n_best = sum(counts[link] == best[link[1]] for link in links)
        said = ";".join(text for _, text in groups)
        digest = hashlib.sha256(said.encode()).hexdigest()
        out.append((n_a, n_b, len(groups), len(links), n_best, sum(counts[x] for x in links), digest))
    return out


def test_against_libraries(spark, tokens):
    pick = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "the", "Ünd", "語", "12", "'s", ".", "▁", "\xa0", "é", "\x1f", "!?"]
    texts = TEXTS + ["".join(pick.choices(parts, k=pick.randint(1, 30))) for _ in range(300)]
    rows = [(i if i % 7 else None, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair int, n string")
    got = alignment.align(docs.repartition(5)).collect()
    expected = [(row[0], *found) for row, found in zip(rows, plain(tokens, texts), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_documents(spark, tokens):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = [(row[0], *found) for row, found in zip(rows, plain(tokens, [r[1] for r in rows]), strict=True)]
    got = llm_queries()["op13_alignment"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_long_texts_in_parts(monkeypatch, tokens):
    text = "some words, then  more\n of them; " * 40
    whole = [piece for _, pieces in alignment.parts([text]) for piece in pieces]
    monkeypatch.setattr(alignment, "PART_CHARS", 50)
    cut = list(alignment.parts([text]))
    assert len(cut) > 10 and [piece for _, pieces in cut for piece in pieces] == whole
    held = alignment.Encoder(tokens)
    for kept in (1000, 2):
        monkeypatch.setattr(alignment, "KEPT_PIECES", kept)
        numbers = held.numbered(whole)
        a, b = held.ids_of(0, numbers)[0], held.ids_of(1, numbers)[0]
        assert a.tolist() == tokens.a.encode(" " + text).ids and b.tolist() == tokens.b.encode(text)
        assert len(alignment.Alignment.of(a, b, tokens.sizes).pairs()) == plain(tokens, [text])[0][2]


def test_pair_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 48, 5000))
    made = alignment.PairHash.of(keys)
    assert sorted(made.find(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(keys + 1, keys)
    assert (made.find(others) == -1).all()
    assert len(alignment.PairHash.of(np.zeros(0, np.int64)).find(keys[:0])) == 0
    assert (alignment.PairHash.of(keys[:0]).find(keys[:3]) == -1).all()


def test_vectors_add_up(spark):
    pairs = [(i * 3 << 32 | i % 5, i % 11 + 1) for i in range(500)] * 3
    counted = spark.createDataFrame(pairs, "pair long, n long").repartition(40)
    counts = alignment.Counts.of(counted)
    found, best = counts.look_up(np.array([p for p, _ in pairs[:500]], dtype=np.int64))
    assert found.tolist() == [3 * (i % 11 + 1) for i in range(500)]
    assert best.tolist() == [n == 33 for n in found.tolist()]
    assert counts.look_up(np.array([77], dtype=np.int64))[0].tolist() == [0]


def test_every_pass_gets_small_batches_of_short_ids(spark, monkeypatch):
    setting, kept = "spark.sql.execution.arrow.maxBytesPerBatch", alignment.store
    text = "some words, and then more of them; " * 3000
    docs = spark.createDataFrame([(i, text) for i in range(200)], "doc_id long, text string")
    before, largest, ids = spark.conf.get(setting), {}, {}

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    def spied(df, name, *more):
        # A probe in the same place as the pass that is stored now.
        probe = docs.coalesce(1).mapInArrow(sizes, "size long")
        largest[name] = max(row["size"] for row in probe.collect())
        made = kept(df, name, *more)
        if name == "both-ids":
            ids.update({row["doc_id"]: len(row["a"]) + len(row["b"]) for row in made.collect()})
        return made

    monkeypatch.setattr(alignment, "store", spied)
    rows = alignment.align(docs).collect()
    assert len(largest) == 3 and max(largest.values()) < 2 * alignment.BATCH_BYTES < docs.count() * len(text)
    assert {row["doc_id"]: 2 * (row["n_a"] + row["n_b"]) for row in rows} == ids
    assert spark.conf.get(setting) == before


def test_wide_ids(spark, tokens):
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(TEXTS)], "doc_id long, text string")
    found = []
    for width in (2, 4):
        encoded = alignment.encode(docs, "doc_id", width=width)
        counts = alignment.Counts.of(alignment.pair_counts(encoded, width))
        found.append(sorted(map(tuple, alignment.alignments(encoded, counts, "doc_id", width=width).collect())))
    assert found[0] == found[1] and tokens.width() == 2


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
