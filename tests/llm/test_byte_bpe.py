"""Byte-level BPE against the library that uses the same ranks."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from tillwise.llm import byte_bpe
from tillwise.llm.tokenizer_files import PATTERN, vocabulary


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(vocabulary(byte_bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


PARTS = [*"ab1!'", " ", "  ", "   ", "\n", " \n", "\t", "\r\n", "\0", "'s", "'ll", "é", "É"]
PARTS += ["日本", "😀", "\x1c", "\x85", "\xa0", " ", "　", "é", "the", "ing", "The "]
PARTS += ["?!...", "x" * 300, "word.", "(a)", "½", "٣"]


def test_texts_of_all_kinds(bpe, library):
    pick = random.Random(3)
    texts = ["".join(pick.choices(PARTS, k=pick.randint(0, 25))) for _ in range(3000)]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_one_piece_of_great_length(bpe, library):
    text = "abcdefghij" * 5000 + "é" * 3000
    assert np.frombuffer(bpe.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_table(spark, library):
    rows = [(1, "a b"), (1, "a b"), (None, None), (3, ""), (4, "Größe " * 9)]
    docs = spark.createDataFrame(
        [(i, t, "x", 0) for i, t in rows], "doc_id long, text string, ids string, n_tokens int"
    )
    made = byte_bpe.decode(byte_bpe.encode(docs, "doc_id"), "doc_id").collect()
    got = sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded), r.n_tokens) for r in made)
    want = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((str(i), ids.tobytes(), (t or "").encode(), len(ids)))
    assert got == sorted(want)
    assert byte_bpe.encode(docs.limit(0), "doc_id").count() == 0


def test_query(spark, library):
    from tillwise.llm.registry import llm_queries

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in llm_queries()["op7_byte_bpe"](spark, folder).collect()}
    assert got.keys() == docs.keys()
    for key, text in docs.items():
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        row = got[key]
        assert (row.n_tokens, row.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
