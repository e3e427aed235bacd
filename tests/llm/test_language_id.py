"""Language codes: the code's distances, decoding, held-out accuracy."""

import numpy as np
import pytest

from tillwise.llm import language_id
from tillwise.llm.language_id import UNDETERMINED, LanguageCode, codewords, decode

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords(n):
    words = codewords(n).astype(int)
    apart = (words[:, None] != words[None]).sum(axis=2)[~np.eye(n, dtype=bool)]
    assert apart.min() >= max(1, words.shape[1] // 4)
    assert (np.abs(words.sum(axis=0)) < n).all()


def test_decoding_corrects_a_bit():
    words = codewords(4)
    code = LanguageCode(tuple("abcd"), words, np.zeros((1, 7)), np.full(7, 1 / 7))
    margins = words.astype(float)
    margins[np.arange(4), np.arange(4)] *= -1
    best, score, gap = decode(code, margins)
    assert best.tolist() == [0, 1, 2, 3] and (score > 0.5).all() and (gap > 0).all()
    best, _, gap = decode(code, np.zeros((1, 7)))
    assert best.tolist() == [0] and gap[0] == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in language_id.fit_and_predict(docs).collect() if r.held_out]
    assert len(rows) > 200
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(i, "the cat sat on the mat " * 3, "en") for i in range(8)]
    rows += [(i, "der Hund lag auf dem Bett " * 3, "de") for i in range(8, 16)]
    rows += [(1, rows[1][1], "en"), (20, None, "en"), (21, "", None), (22, "12 .. \n", "de"), (None, "the mat", None)]
    rows += [(23, "der " * 100_000, None), (24, "É", ""), (25, "日", None)]
    schema = "doc_id long, text string, lang string, score string, lang_pred int"
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    got = language_id.fit_and_predict(docs).collect()
    assert len(got) == len(rows)
    told = {(r.doc_id, r.lang_pred) for r in got}
    assert {(20, UNDETERMINED), (21, UNDETERMINED), (22, UNDETERMINED), (23, "de"), (None, "en")} <= told
    assert {r.lang_pred for r in got if r.doc_id in (24, 25)} <= {"en", "de"}
    assert language_id.fit_and_predict(docs.limit(0)).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language_id.fit_and_predict(unlabelled).collect()} == {UNDETERMINED}
    one = docs.where("lang = 'en'")
    assert {r.lang_pred for r in language_id.fit_and_predict(one).collect()} == {"en", UNDETERMINED}
