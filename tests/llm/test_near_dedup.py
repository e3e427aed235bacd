"""Near duplicates against all pairs, and the guarantee of the multi-index join."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import near_dedup
from tillwise.llm.components import components
from tillwise.llm.near_dedup import CHUNKS, RADIUS, SYMBOLS, chunk_keys

UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def by_all_pairs(texts):
    """Place by place: the size of the set, and the places linked with it."""
    sets = [shingles(text) for text in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def corpus(seed):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "é", "ß", "日本"]
    texts = [None, "", " \n\t", "one", "One", "two words", "three small words", "a b c d", "a b c d"]
    for _ in range(40):
        base = pick.choices(words, k=pick.randint(4, 120))
        texts.append(" ".join(base))
        for _ in range(pick.randint(0, 6)):
            changed = list(base)
            for _ in range(pick.randint(0, 4)):
                changed[pick.randrange(len(changed))] = pick.choice(words)
            texts.append(pick.choice([" ", "\n", "\x0b "]).join(changed).title())
    passage = pick.choices(words, k=60)
    texts += [" ".join(passage + pick.choices(words, k=pick.randint(5, 60))) for _ in range(60)]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame(
        [(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, class int, a string"
    )
    sizes, groups = by_all_pairs(texts)
    least = {g: min(i for i, h in enumerate(groups) if h == g) for g in groups}
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    for i, (size, group) in enumerate(zip(sizes, groups, strict=True)):
        row = got[i]
        assert (row.n_shingles, row.component_id, row.kept) == (size, least[group], least[group] == i)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    test_all_pairs(spark, 3)


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(7, text), (7, text), (9, text + " x"), (None, text + " y"), (None, "alone by itself"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(
        near_dedup.near_duplicates(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_shingles)
    )
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [
        (7, 7, True), (7, 7, True), (8, 8, True), (9, 7, False), (None, None, True), (None, 7, False)
    ]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_pigeonhole():
    random_ = np.random.default_rng(5)
    one = random_.integers(0, 2**16, (500, SYMBOLS)).astype(np.uint16)
    other = one.copy()
    for row in other:
        row[random_.choice(SYMBOLS, RADIUS, replace=False)] ^= 1
    # The worst case: two differences in every chunk but one.
    worst = np.concatenate([np.linspace(0, SYMBOLS, CHUNKS + 1).round().astype(int)[:-1] + k for k in (0, 1)])
    other[0] = one[0]
    other[0][worst[:-1]] ^= 1
    assert ((one != other).sum(axis=1) <= RADIUS).all()
    assert (chunk_keys(one) == chunk_keys(other)).any(axis=1).all()


@pytest.mark.parametrize("shape", ["path", "star", "cycles", "none"])
def test_components(spark, shape):
    n = 60
    links = {
        "path": [(i, i + 1) for i in range(n)],
        "star": [(5, i) for i in range(n)],
        "cycles": [(i, (i + 7) % n) for i in range(n)] + [(100, 101), (101, 100), (200, 200)],
        "none": [],
    }[shape]
    made = components(spark.createDataFrame(links, "a long, b long")).collect()
    root = {r.node: r.root for r in made}
    assert len(root) == len(made) == len({x for a, b in links if a != b for x in (a, b)})
    for a, b in links:
        if a != b:
            assert root[a] == root[b]
    groups = {"path": 1, "star": 1, "cycles": 2, "none": 0}[shape]
    assert len(set(root.values())) == groups


def test_rows_of_a_hot_key_grow_in_proportion(spark, monkeypatch):
    """A family that is connected but for a few classes goes to the blocks of these alone."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)

    def counted(held, cell):
        import pyarrow as pa

        ids = pa.array([row[1] for row in held], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, ids], names=["a", "b"])

    monkeypatch.setattr(near_dedup, "_apart", counted)
    rows = {}
    for n in (400, 800):
        ids = spark.range(n)
        sign = near_dedup.signature(np.arange(9, dtype=np.uint64)).tobytes()
        classes = ids.selectExpr("id class", "9L n_shingles").withColumn("signature", F.lit(sign))
        classes = classes.withColumn("bits", F.lit(near_dedup.bitmap(np.arange(9, dtype=np.uint64))))
        keyed = ids.selectExpr("7L key", "id class", "cast(0 as smallint) slot", f"{n // 8} blocks")
        roots = ids.selectExpr("id node", "case when id < 5 then id else 5 end root")
        rows[n] = near_dedup._across(keyed, roots, classes).count()
        assert rows[n] <= n + 5 * (n // 8 + 2)
    assert rows[800] < 2.2 * rows[400]
