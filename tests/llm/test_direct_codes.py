"""Token files against the tokenizers library and plain arrays."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tillwise.llm import direct_codes
from tillwise.llm.direct_codes import Segment, WordBpe, pack
from tillwise.llm.stored import new_path
from tillwise.llm.tokenizer_files import vocabulary

PARTS = [*"ab1!", " ", "  ", "\n", "\t", "'s", "'ll", "é", "É", "日本", "23", "?!", "\x1c", "\x85"]
PARTS += ["\xa0", "　", "́", "<", "̸", "😀", "the", "ing", "The ", "İ", "Σ", "word.", "½"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary(direct_codes.VOCABULARY))


def _ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_texts_of_all_kinds(library):
    pick = random.Random(4)
    texts = ["".join(pick.choices(PARTS, k=pick.randint(0, 12))) for _ in range(3000)]
    among = pa.array(["É before", *texts, "after É"])[1:-1]
    flat, counts = WordBpe(vocabulary(direct_codes.VOCABULARY)).encode(among)
    found = [x.tobytes() for x in np.split(flat, np.cumsum(counts)[:-1])]
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == _ids(library, text), repr(text)


def test_special_names(library):
    texts = ["<|endoftext|>", "<|ENDOFTEXT|>", "A <|EndOfText|> B", "x<|startoftext|>Y", "THE END", "Ends.", ""]
    flat, counts = WordBpe(vocabulary(direct_codes.VOCABULARY)).encode(pa.array(texts))
    found = np.split(flat, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in found] == [_ids(library, text) for text in texts]


def test_letters_of_two_bytes_beside_punctuation(library):
    signs = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]
    texts = [f"A{chr(i)}{sign}{chr(i)}b{sign}'s 1" for i in range(0x80, 0x800) for sign in signs]
    flat, counts = WordBpe(vocabulary(direct_codes.VOCABULARY)).encode(pa.array(texts))
    found = np.split(flat, np.cumsum(counts)[:-1])
    made = library.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [text for text, ids, one in zip(texts, found, made, strict=True) if ids.tolist() != one.ids]
    assert wrong == []


def test_library_sees_each_word_once(monkeypatch):
    """However it is written: in capitals, at a line's end, beside punctuation."""
    bpe = WordBpe(vocabulary(direct_codes.VOCABULARY))
    asked, ask = [], bpe._encode
    monkeypatch.setattr(bpe, "_encode", lambda texts: asked.extend(" ".join(texts).split()) or ask(texts))
    texts = ["tréma größe", "Tréma\ngröße###", "(größe) tréma.\nGRößE, tréma-größe", "größe/tréma;"]
    bpe.encode(pa.array(texts[:2]))
    bpe.encode(pa.array(texts))
    assert sorted(word for word in asked if word[0].isalpha()) == ["größe", "tréma"]
    assert len(asked) == len(set(asked))


def test_random_access():
    pick = random.Random(5)
    edges = [0, 255, 256, 65535, 65536, 2**32 - 1]
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.array([pick.choice([*edges, pick.randrange(50_000)]) for _ in range(n)], np.uint32)
        segment = Segment(pack(ids))
        assert segment.tokens(0, n).tolist() == ids.tolist()
        assert [segment.token(i) for i in range(n)] == ids.tolist()
        for _ in range(50):
            start, stop = sorted((pick.randint(0, n), pick.randint(0, n)))
            assert segment.tokens(start, stop).tolist() == ids[start:stop].tolist()


def _expected(library, docs):
    start, rows = 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = np.array([*_ids(library, text or ""), 2], "<u4")
        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return rows


def test_table(spark, library, monkeypatch):
    rows = [(5, "a b"), (5, "a b"), (5, "c"), (None, None), (3, ""), (-4, "Größe " * 999)]
    rows += [(i, f"word {i}") for i in range(100, 160)]
    docs = spark.createDataFrame(
        [(i, t, "x", 0) for i, t in rows], "doc_id long, text string, bucket string, part int"
    )
    path = new_path(spark, "ids")
    direct_codes.write(docs, path)
    made = direct_codes.read(spark.read.parquet(path)).collect()
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in made]
    assert sorted(got, key=lambda r: r[1]) == _expected(library, rows)
    direct_codes.write(docs.limit(0), f"{path}-empty")
    assert direct_codes.read(spark.read.parquet(f"{path}-empty")).count() == 0


def test_query(spark, library):
    from tillwise.llm.registry import llm_queries

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [tuple(r) for r in llm_queries()["op6_direct_codes"](spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == _expected(library, docs)
