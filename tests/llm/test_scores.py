"""Quality and toxicity: their parts, held-out accuracy, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillwise.llm import quality, toxicity
from tillwise.llm.labelled import sample

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    names = ("documents", "labels")
    return [spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in names]


def _held_out(spark, tables, scored, label):
    rows = scored.where("held_out").join(tables[1], "doc_id").select("predicted", label).collect()
    predicted, labels = np.array(rows).T
    assert len(rows) > 500
    return predicted, labels


def test_quality_of_held_out(spark, tables):
    scored = quality.fit_and_score(*tables).cache()
    assert scored.agg(F.min("score"), F.max("score")).first()[0] >= 0
    predicted, labels = _held_out(spark, tables, scored, "quality")
    assert (predicted == labels).mean() >= 0.97
    assert predicted[labels == 1].mean() >= 0.99


def test_toxicity_of_held_out(spark, tables):
    scored = toxicity.fit_and_score(*tables).cache()
    predicted, labels = _held_out(spark, tables, scored, "toxic")
    assert (predicted == labels).mean() >= 0.96
    assert predicted[labels == 1].mean() >= 0.8
    assert predicted[labels == 0].mean() <= 0.02


def test_isotonic():
    x = np.array([3.0, 1, 2, 2, 5, 4])
    y = np.array([0.0, 0, 1, 0, 1, 1])
    means, values = quality.isotonic(x, y)
    assert (np.diff(means) > 0).all() and (np.diff(values) >= 0).all()
    assert means.tolist() == [1, 7 / 3, 4.5]


def test_statistics_of_odd_texts():
    found = quality.statistics(pa.array(["", None, " ", "a", "É!", "x " * 50_000]))
    assert np.isfinite(found).all() and not found[:2].any()


@pytest.mark.parametrize("fit", [quality.fit_and_score, toxicity.fit_and_score])
def test_odd_rows(spark, fit):
    rows = [(i, f"plain words of text number {i}") for i in range(60)]
    rows += [(i, f"plain idiot of text idiot {i}") for i in range(60, 120)]
    rows += [(5, rows[5][1]), (200, None), (201, ""), (None, "idiot idiot"), (202, "word " * 200_000), (203, "\n")]
    schema = "doc_id long, text string, score string, label int, half int"
    docs = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], schema)
    marks = [(i, int(i < 60), int(i >= 60), "x") for i in range(120)] + [(7, None, None, "x"), (None, 1, 0, "x")]
    marks += [(8, 1, 0, "x"), (8, 1, 0, "x"), (999, 1, 1, "x")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")
    got = fit(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert fit(docs.limit(0), labels).count() == 0
    assert fit(docs, labels.limit(0)).count() == len(rows)


def test_sample_is_bounded_and_never_held_out(spark, tables):
    docs, labels = tables
    some = sample(docs, labels, "toxic", 300)
    assert 200 < some.count() < 400
    from_held_out = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert sample(docs, from_held_out, "toxic", 300).count() == 0


def _plain_letters():
    # A model of a few words: what follows what in them is likely, the rest is not.
    counts = np.full((28, 28, 28), 0.01)
    for word in ("idiot", "stupid", "pathetic", "scum", "loser", "the", "hello") * 20:
        symbols = [0, 0, *[ord(c) - 96 for c in word], 0]
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            counts[a, b, c] += 1
    return np.log(counts / counts.sum(axis=2, keepdims=True)).ravel()


@pytest.mark.parametrize(
    "disguised, plain",
    [("1d10t", "idiot"), ("i d i o t", "idiot"), ("st.u.p.i.d", "stupid"), ("p4th3t1c", "pathetic"),
     ("$cum", "scum"), ("l0ssseeer", "loser"), ("idiiiiot", "idiot"), ("st*pid", "stupid")],
)
def test_restoring(disguised, plain):
    restorer = toxicity.Restorer(_plain_letters())
    assert restorer.suspect(disguised)
    assert restorer.restore(disguised).split()[0] == plain


def test_plain_words_have_no_other_reading():
    for word in ("hello", "é", "naïve", "2024", "don't".replace("'", "")):
        assert not toxicity.Restorer.suspect(word)
    reader = toxicity.Reader(_plain_letters())
    assert reader.words("IDIOT!!") == ["idiot"]
    assert "idiot" in reader.words("1D10T,")
    assert "idiot" in [w for t in reader.tokens("an i d i o t here") for w in reader.words(t)]


def test_letter_counts(spark):
    docs = spark.createDataFrame([("ab  É",), ("AB",), (None,), ("",)], "text string")
    got = {r.gram: r.n for r in toxicity.count_letters(docs).collect()}
    n = toxicity.SYMBOLS
    assert got[(1 * n + 2) * n + 0] == 2
    assert got[(2 * n + 0) * n + 27] == 1
    assert toxicity.count_letters(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "said, plain",
    [("l 0 $ e r", "loser"), ("! d ! 0 t", "idiot"), ("s - t - u - p - i - d", "stupid"), ("$ t u p ! d", "stupid"),
     ("p @ t h e t ! c", "pathetic"), ("sttupid", "stupid"), ("i d d i o t t", "idiot"), ("s ( u m !", "scum")],
)
def test_combined_disguises(said, plain):
    reader = toxicity.Reader(_plain_letters())
    assert plain in [w for t in reader.tokens(f"so {said} here") for w in reader.words(t)]


def test_signs_at_the_end_may_be_letters(spark):
    docs = spark.createDataFrame([("kiss the boss, a mass of glass and less fuss, ass is in class",)], "text string")
    reader = toxicity.Reader(toxicity.letter_model(docs))
    assert "ass" in reader.words("a$$") and "kiss" in reader.words("ki$$")
    assert reader.words("boss!!") == ["boss"]


def test_planted_disguises(spark, tables):
    pick = np.random.default_rng(3)
    common = ["the", "people", "were", "walking", "along", "river", "and", "spoke", "about", "bread", "weather", "music"]
    bad = ["idiot", "stupid", "pathetic", "loser"]
    said = lambda: pick.choice(common, 30).tolist()
    rows, marks = [], []
    for i in range(400):
        words = said()
        if i % 2:
            words[3:28:5] = [bad[i // 2 % 4]] * 5
        rows.append((i, " ".join(words)))
        marks.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    scorer = toxicity.Scorer(model)
    planted = ["l 0 $ e r", "! d ! 0 t", "s - t - u - p - i - d", "p @ t h e t ! c", "stu pid", "$tu p!d", "pathe tic", "sttupidd"]
    texts = [" ".join([*said(), hidden, *said()]) for hidden in planted]
    clean = [" ".join(said()) for _ in range(20)] + ["the bread!! and the music*** were a$$$ ( the people )"]
    assert (scorer.score(texts) >= toxicity.THRESHOLD).all(), scorer.score(texts)
    assert (scorer.score(clean) < toxicity.THRESHOLD).all()
