"""The pipeline's stages one by one, and as a whole."""

import numpy as np
import tiktoken

import corpus_pipeline
from corpus_pipeline import STAGES, run
from tillwise.llm import byte_bpe, near_dedup
from tillwise.llm.tokenizer_files import PATTERN

FOLDER = "/root/testdata/sf0.001"


def test_whole(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = run(spark, FOLDER).collect()
    assert 0 < len(rows) < len(docs) and len({r.doc_id for r in rows}) == len(rows)
    bpe = byte_bpe.load(byte_bpe.VOCABULARY)
    library = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for r in rows:
        text = docs[r.doc_id].text
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert (r.lang, r.source) == (docs[r.doc_id].lang, docs[r.doc_id].source)


def test_stages(spark):
    assert [name for name, _ in STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "byte_bpe"]
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = " ".join(f"clean{i}" for i in range(40))
    rows = [(1, clean, "en"), (2, clean + " more", "en"), (1, clean, "en"), (3, None, "en"), (4, "12 34 !", None)]
    rows += [(5, "", "en"), (None, "nobody's words here", "en"), (6, "before " + items[0] + " after", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, row string, kept int"
    docs = spark.createDataFrame([(*r, "s", 1, 2, "x", 0) for r in rows], schema)
    kept = {}
    for name, stage in STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        made = stage(spark, docs, FOLDER)
        if name != "byte_bpe":
            assert made.columns == docs.columns
        kept[name] = sorted(((r.doc_id is None, r.doc_id or 0) for r in made.collect()))
    assert len(kept["toxicity"]) == len(kept["byte_bpe"]) == len(rows)
    assert kept["language"] == [(False, 1), (False, 1), (False, 2), (False, 6), (True, 0)]
    assert [i for _, i in kept["near_duplicates"]] == [1, 3, 4, 5, 6, 0]
    assert (False, 6) not in kept["decontamination"] and len(kept["decontamination"]) == len(rows) - 1


def test_no_sql():
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_duplicates_by_five_words(spark):
    pick = np.random.default_rng(4)
    texts = []
    for changes in (5, 6, 6, 7, 7, 8, 9):
        base = [f"w{n}" for n in pick.integers(0, 5000, 300)]
        other = list(base)
        for at in range(10, 10 + 40 * changes, 40 if changes < 8 else 30):
            if at < 300:
                other[at] = "changed"
        texts += [" ".join(base), " ".join(other)]
    texts += ["one two three four", "one two three four", "a b c d e", "a b c d f"]

    def shingles(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [shingles(text) for text in texts]
    groups = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                groups = [groups[j] if g == groups[i] else g for g in groups]
    rows = [(i, text, "en") for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(groups))
    four = near_dedup.without_duplicates(docs).collect()
    assert len(four) < len(kept) < len(texts)


def test_names_that_clash(spark):
    """Columns of any name, rows without ids, and two texts of one id."""
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text), (None, text), (None, text + " more"), (7, "a b c d e f"), (7, "a b c d e f"), (7, "A b c d e f")]
    rows += [(8, "other words that stand alone here"), (None, "x " + items[0]), (9, ""), (9, ""), (None, None), (None, None)]
    schema = "doc_id long, text string, lang string, source string, _id int, _key string, class int, `first` int"
    docs = spark.createDataFrame([(*r, "en", "s", 1, "k", 2, i) for i, r in enumerate(rows)], schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    found = sorted((str(r.doc_id), (r.text or "").lower()[:9]) for r in kept.collect())
    assert found == sorted([
        ("None", "word0 wor"), ("7", "a b c d e"), ("8", "other wor"), ("None", ("x " + items[0]).lower()[:9]),
        ("9", ""), ("None", ""), ("None", ""),
    ])
    clean = corpus_pipeline.drop_contaminated(spark, docs, FOLDER)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 1


def test_no_language_learnt(spark):
    rows = [(1, "clean words", None), (2, "12 34", None), (3, None, ""), (4, "日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_without_language(spark, docs, FOLDER).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4]
